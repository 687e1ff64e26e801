"""Rules fire on sentences that state a practice and keep quiet on those that state the control.

``CASES`` were at hand when patterns were written; ``HELD`` were written afterwards and no pattern was changed for them,
so they say how far the patterns reach beyond what they were written for.
"""

from __future__ import annotations

import pytest

from quarrylens.operators import rules
from quarrylens.plans.rule_catalogue import RULES

CASES = [
    ("NET-MGMT-001", "The bakery's oven controllers report by SNMP version 2c.", "The bakery's oven controllers report by SNMPv3 with encryption."),
    ("NET-SEG-001", "The museum's core filter ends in permit ip any any.", "The museum's core filter ends in deny ip any any."),
    ("NET-SEG-003", "The harbour router permits all traffic between the crane and the office networks.", "The harbour router lets the crane network send to one broker."),
    ("NET-HA-001", "The clinic hangs on one leased line with no backup path.", "The clinic has two leased lines from two carriers."),
    ("NET-HA-002", "Two fibres leave the cold store, and both end in the same switch.", "Two fibres leave the cold store and end in different halls."),
    ("NET-RTG-001", "Depots exchange their routes by EIGRP.", "Depots exchange their routes by EIGRP with SHA authentication."),
    ("NET-WLS-001", "Forklift tablets join the hall's network with WPA2-PSK.", "Forklift tablets join the hall's network with certificates."),
    ("NET-EGR-001", "Ticket printers may open connections to any host on the internet.", "Ticket printers can not open connections to any host on the internet."),
    ("APP-SEC-001", "The till's database password is kept in a configuration file beside the program.", "The till asks the vault for a short-lived login."),
    ("APP-SEC-001", "A hard-coded secret unlocks the seed dispenser.", "The seed dispenser is unlocked by a badge."),
    ("APP-AUTH-001", "The timetable export endpoint needs no login.", "The timetable export endpoint checks a signed ticket."),
    ("APP-AUTH-001", "The donation callback is taken without any authentication.", "The donation callback carries a signature that is checked."),
    ("APP-DATA-001", "The reader's search term is pasted into the WHERE clause.", "The reader's search term is bound to a prepared statement."),
    ("APP-TLS-001", "Meter readings are sent over HTTP to the depot.", "Meter readings are sent over HTTPS to the depot."),
    ("APP-SSRF-001", "The poster maker downloads whichever address the visitor types.", "The poster maker offers twelve pictures of its own."),
    ("APP-AUTHZ-002", "Parcel numbers in the tracking link are consecutive.", "Parcel links carry a random code of 20 letters."),
    ("APP-UPLOAD-001", "Tenants attach photographs or files with any extension to a repair.", "Tenants attach JPEG photographs to a repair."),
    ("APP-SESS-001", "A cashier's session stays valid after sign-out.", "A cashier's session ends with the shift."),
    ("APP-CICD-001", "The registry credential is visible to every job of the project.", "The registry credential belongs to the publishing job."),
    ("APP-CICD-003", "The greenhouse controller is rolled out from an image tag that is overwritten each night.", "The greenhouse controller is rolled out by its digest."),
    ("APP-PWD-001", "Members choose a password of at least 6 characters.", "Members choose a passphrase of four words."),
    ("CLD-STOR-001", "Anyone on the internet can read the choir's recordings bucket.", "The choir's recordings bucket is shared with its members."),
    ("CLD-STOR-001", "The herd database is publicly reachable for the vets.", "The herd database has a private endpoint for the vets."),
    ("CLD-LZ-001", "One subscription holds the production and the test systems of the ferry line.", "Each system of the ferry line has a subscription of its own."),
    ("CLD-K8S-001", "The EKS control plane is public.", "The EKS control plane is reached from the office alone."),
    ("SEC-VULN-001", "The weighbridge computer stays on Windows 7.", "The weighbridge computer gets a release with support."),
    ("SEC-IAM-001", "Root login on the brewery's servers is by password-only access, without MFA.", "Root login on the brewery's servers takes a smart card."),
    ("SEC-IAM-002", "Nurses on the ward use the same login.", "Each nurse on the ward has a badge."),
    ("SEC-IAM-004", "All staff can delete bookings.", "Two planners can delete bookings."),
    ("SEC-PKI-001", "The root CA key lies on a USB stick in a drawer.", "The root CA key was made in a key ceremony and stays in an HSM."),
    ("SEC-RES-001", "The nightly backup is written to the same server as the ledger.", "Copies of the ledger are kept in another town."),
    ("SEC-EXC-001", "Certificate checks are switched off for the oldest parking meters.", "Certificate checks hold for all parking meters."),
    ("OT-FW-001", "Turbines fetch their firmware via http.", "Turbines fetch signed firmware from the vendor."),
]
HELD = [
    ("NET-HA-001", "A lone router joins the ski lift to the valley, without a spare.", "Two routers join the ski lift to the valley."),
    ("NET-EGR-001", "From the laboratory any machine can reach every site on the public internet.", "From the laboratory machines reach a mirror of packages."),
    ("APP-AUTH-001", "The stock levels page can be called without logging in.", "The stock levels page asks for the dealer's sign-in."),
    ("APP-DATA-001", "The member's postcode is glued into the SQL of the report.", "The member's postcode is a parameter of the report."),
    ("APP-SSRF-001", "The recipe importer pulls any link the member pastes.", "The recipe importer reads recipes from two partners."),
    ("APP-UPLOAD-001", "Applicants may add documents in whatever format.", "Applicants may add documents as PDF."),
    ("APP-CICD-003", "Scanners run a release tag which can be moved.", "Scanners run a release known by its hash."),
    ("CLD-STOR-001", "Snapshots of the archive may be downloaded by anyone.", "Snapshots of the archive are encrypted and kept apart."),
    ("CLD-LZ-001", "Staging and production of the lottery live in the same account.", "Staging of the lottery lives in an account of its own."),
    ("SEC-IAM-002", "The night shift signs in with a common user name.", "The night shift signs in by fingerprint."),
    ("SEC-PKI-001", "The lock maker's firmware signing key is copied to a flash drive.", "The lock maker's firmware is signed in a secured module."),
    ("SEC-EXC-001", "Hostname verification was skipped for the tram's display units.", "Hostname verification covers the tram's display units."),
]
#: A control that stands suppresses; one that is declined does not.
GUARDS = [
    ("MFA is enforced for all of them", True),
    ("MFA was considered", False),
    ("there is no MFA", False),
    ("they lack MFA", False),
    ("MFA will be added in a later phase", False),
    ("MFA is on the roadmap", False),
    ("MFA was found to be inflexible", False),
    ("MFA is required, and nothing is exempt", True),
    ("MFA was deferred, yet MFA is now mandatory", True),
]


def scan(spark, bodies: dict[int, str], topics: dict[int, tuple[str, ...]]):
    rows = [(k, 0, "Heading", body, (topics[k] or ("context_scope",))[0], list(topics[k][1:])) for k, body in bodies.items()]
    typed = spark.createDataFrame(rows, "doc_id bigint, index int, heading string, body string, topic string, secondary_topics array<string>")
    return {(r["doc_id"], r["rule_id"]) for r in rules.run_rules(typed).collect()}


@pytest.fixture(scope="module")
def found(spark):
    topics = {r.id: r.topics for r in RULES}
    cases = CASES + HELD
    bodies = {2 * k + quiet: case[1 + quiet] for k, case in enumerate(cases) for quiet in (0, 1)}
    return scan(spark, bodies, {k: topics[cases[k // 2][0]] for k in bodies})


@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{c[0]}-{k}" for k, c in enumerate(CASES)])
def test_rule_fires_and_keeps_quiet(found, k):
    assert (2 * k, CASES[k][0]) in found, CASES[k][1]
    assert (2 * k + 1, CASES[k][0]) not in found, CASES[k][2]


def test_rules_reach_sentences_that_they_were_not_written_for(found):
    own = range(len(CASES), len(CASES) + len(HELD))
    fired = [(2 * k, HELD[k - len(CASES)][0]) in found for k in own]
    assert sum(fired) >= 0.6 * len(HELD), [c[1] for c, f in zip(HELD, fired, strict=True) if not f]
    assert not [HELD[k - len(CASES)][2] for k in own if (2 * k + 1, HELD[k - len(CASES)][0]) in found]


def test_declined_controls_do_not_suppress(spark):
    topics = next(r.topics for r in RULES if r.id == "SEC-IAM-001")
    bodies = {k: f"Privileged access goes through the jump host; {said}." for k, (said, _) in enumerate(GUARDS)}
    hit = scan(spark, bodies, dict.fromkeys(bodies, topics))
    assert {k: (k, "SEC-IAM-001") not in hit for k in bodies} == {k: stands for k, (_, stands) in enumerate(GUARDS)}
