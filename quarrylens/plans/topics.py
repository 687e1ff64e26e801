"""Topics, completeness criteria and scope markers: a catalogue of this library's own, to be replaced where another is in use.

Each function that uses them takes another catalogue as a parameter. Keys, domains and their order are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

GENERAL = "general"
DOMAINS = ("network", "application", "security", "cloud_data")


@dataclass(frozen=True)
class Topic:
    key: str
    label: str
    domain: str
    keywords: tuple[str, ...]
    query_terms: tuple[str, ...] = ()


def _t(key: str, domain: str, words: str, terms: str = "") -> Topic:
    pick = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    return Topic(key, key.replace("_", " ").capitalize(), domain, pick(words), pick(terms))


TOPICS = (
    _t("access_layer", "network", "wall port, patch panel, edge switch, endpoint admission, mac address, poe, floor switch", "who may plug in"),
    _t("distribution_core", "network", "backbone, leaf switch, chassis, line card, campus core, switching fabric", "backbone layout"),
    _t("routing", "network", "routing table, autonomous system, next hop, neighbour, prefix list, ospf, bgp", "exchange of routes"),
    _t("wan_edge", "network", "leased line, branch office, carrier, site-to-site, broadband, border router, last mile", "links between sites"),
    _t("segmentation", "network", "vlan, packet filter, firewall rule, trust zone, isolated network, micro-perimeter, deny by default", "separation of networks"),
    _t("ha_resilience", "network", "standby, second path, active-active, heartbeat, failover, spare unit, diverse path", "surviving a lost device"),
    _t("network_management", "network", "snmp, management station, console server, polling, jump host, device configuration, netflow", "running the devices"),
    _t("wireless", "network", "wlan, ssid, radio channel, roaming, captive portal, wireless controller", "radio access"),
    _t("dns_dhcp_ipam", "network", "name server, domain name, address pool, lease time, reverse lookup, dnssec", "names and addresses"),
    _t("app_structure", "application", "module, component diagram, service mesh, worker process, monolith, tier, event bus, business logic", "parts of the application"),
    _t("api_integration", "application", "endpoint, openapi, payload, callback, http method, message format, status code, rest", "calls between systems"),
    _t("app_authn_authz", "application", "sign-in, access token, single sign-on, user role, permission check, cookie, password reset", "who may do what"),
    _t("app_data_handling", "application", "form field, file upload, escaping, prepared statement, sanitis, deserial, user input", "care with input"),
    _t("secrets_config", "application", "credential, secret store, config file, feature flag, signing secret, dotenv", "keeping secrets"),
    _t("sdlc_supplychain", "application", "build server, release branch, pull request, third-party package, static analysis, artifact, signed commit, sast", "how code gets out"),
    _t("app_resilience", "application", "backpressure, timeout, idempoten, graceful degradation, health check, bulkhead, dead letter", "behaviour under load"),
    _t("zero_trust", "security", "verify every request, no implicit trust, device posture, per-request, identity-aware", "trust by proof"),
    _t("iam_privileged", "security", "administrator, joiner, break-glass, second factor, entitlement, session recording, elevated right, pam", "powerful accounts"),
    _t("crypto_keys", "security", "key rotation, cipher suite, public key, key escrow, elliptic curve, digital signature, key ceremony", "keys and ciphers"),
    _t("logging_detection", "security", "log collector, alert rule, event correlation, audit trail, anomaly, security operations, edr", "seeing attacks"),
    _t("threat_model", "security", "attacker, misuse case, abuse story, trust boundary, data flow diagram, attack tree", "thinking as an attacker"),
    _t("vuln_patch", "security", "security update, patch window, penetration test, known weakness, unsupported version, hardening guide", "closing holes"),
    _t("resilience_ir", "security", "recovery point, recovery time, tabletop exercise, runbook, restore test, on-call, forensic", "after an incident"),
    _t("cloud_landing_zone", "cloud_data", "cloud account, resource group, tenant, account vending, service control, billing account", "ordering of accounts"),
    _t("iac_posture", "cloud_data", "declarative, state file, provisioning, configuration drift, policy as code, terraform", "infrastructure as text"),
    _t("data_classification", "cloud_data", "sensitivity label, personal data, data owner, special category, restricted data, data inventory", "kinds of data"),
    _t("data_protection", "cloud_data", "encrypted volume, pseudonym, right to erasure, storage key, data masking, retention period, deletion", "care of stored data"),
    _t("cloud_network", "cloud_data", "virtual network, route table, private link, load balancer, hub and spoke, security group, nat", "networks in the cloud"),
    _t("context_scope", GENERAL, "this document, out of scope, background, audience, terminology, constraint, objective"),
)


@dataclass(frozen=True)
class Criterion:
    key: str
    domain: str
    severity: str
    patterns: tuple[str, ...]

    @property
    def label(self) -> str:
        return self.key.replace("_", " ")

    @property
    def issue(self) -> str:
        return f"The document does not state its {self.label}."


CRITERIA = (
    Criterion("data_flow", "application", "MEDIUM", (r"data\s+flows?", r"\bflows?\s+(?:from|between|to)\b", r"\b(?:sends?|forwards?|replicates?)\s+\w+\s+to\b")),
    Criterion("trust_boundaries", "security", "MEDIUM", (r"trust\s+(?:boundar|zone)", r"\bdmz\b", r"security\s+zones?", r"\buntrusted\b")),
    Criterion("authentication_model", "security", "MEDIUM", (r"authenticat", r"\b(?:sso|saml|oidc|oauth|mfa|kerberos)\b")),
    Criterion("data_classification", "cloud_data", "MEDIUM", (r"classif(?:ied|ication)", r"\b(?:confidential|restricted|pii|personal\s+data)\b")),
    Criterion("encryption", "security", "MEDIUM", (r"encrypt", r"\b(?:tls|ipsec|aes|kms)\b")),
    Criterion("third_party", "security", "LOW", (r"third[- ]part", r"\b(?:vendor|supplier|saas|subprocessor)s?\b")),
    Criterion("logging_monitoring", "security", "LOW", (r"\b(?:siem|syslog|monitor(?:ing|ed)?|audit\s+logs?)\b", r"\blogg(?:ed|ing)\b")),
    Criterion("availability", "network", "LOW", (r"availab", r"\b(?:rto|rpo|failover|redundan\w+|sla)\b")),
)
#: Phrases of advertisements and minutes, and signs of a design.
MARKERS = (r"trusted by", r"industry[- ]leading", r"best[- ]in[- ]class", r"world[- ]class", r"contact (?:sales|us)", r"free trial", r"next[- ]generation", r"\battendees\b", r"\bapologies\b", r"\bagenda\b", r"\bminutes\b", r"next meeting", r"\baction:\s")
STRUCTURE = (r"\bport \d+", r"\bvlan ?\d+", r"\bsubnets?\b", r"\b\d{1,3}(?:\.\d{1,3}){3}/\d{1,2}\b", r"\b(?:connects?|sends?|routes?|forwards?|replicates?) (?:to|through|over|via)\b", r"->|→", r"^\s*\|.*\|\s*$", r"\b(?:uplink|trunk|endpoint|load balancer|gateway|broker|cluster)s?\b")
