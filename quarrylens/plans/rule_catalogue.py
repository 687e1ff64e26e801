"""The deterministic rules: identifiers, domains and severities are fixed values, wording and patterns are this library's.

``Rule.hard`` patterns are direct evidence and beat suppressors; ``soft`` ones are dropped where a suppressor names
the control and, for guarded rules, does not decline it. Patterns are Java's, case-insensitive.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    id: str
    domain: str
    severity: str
    issue: str
    soft: tuple[str, ...] = ()
    hard: tuple[str, ...] = ()
    suppressors: tuple[str, ...] = ()
    guard: bool = False
    topics: tuple[str, ...] = ()
    scope: str = "section"
    kind: str = "finding"
    soft_kind: str = "finding"
    advice: str = "Replace the practice by the organisation's standard control and state it in the design."


def _r(id: str, severity: str, issue: str, soft=(), hard=(), unless=(), **more) -> Rule:
    domain = {"NET": "network", "APP": "application", "SEC": "security", "CLD": "cloud_data", "OT": "security"}[id.split("-")[0]]
    tup = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Rule(id, domain, severity, issue, tup(soft), tup(hard), tup(unless), **more)


def near(a: str, b: str, within: int = 80) -> str:
    """Both in one sentence, in either order."""
    return rf"(?:{a})[^\n]{{0,{within}}}?(?:{b})|(?:{b})[^.\n]{{0,{within}}}(?:{a})"


SECRET = r"\b(?:password|passphrase|secret|credential|api\s+key|access\s+key|encryption\s+key|connection\s+string|token)s?\b"
KEPT = r"values[-\w]*\.ya?ml|\bconfigmap\b|config(?:uration)?\s+file|default\s+value|source\s+(?:code|control)|\.env\b|\bwiki\b|\bspreadsheet|user\s+data"
STORE = r"\b(?:bucket|blob|container|storage\s+account|replica|database|snapshot|file\s+share)\w*"
OFF = r"(?:switched|turned|left)\s+off|\bdisabled|\bskipped|\bbypassed|\bsuspended|\bignored"
PEOPLE = r"\b(?:operators?|staff|engineers?|technicians?|team|shift|nurses|clerks|everyone|employees|crew|drivers|cashiers)\b"
C, H, M = "CRITICAL", "HIGH", "MEDIUM"
RULES = (
    _r("NET-MGMT-001", C, "Devices are managed over SNMP v1 or v2c.", r"\bsnmp\s?(?:v(?:ersion)?\s?)?(?:1|2c?)\b", unless=(r"snmp\s?v?3", r"snmp[^.\n]{0,30}disabled"), guard=True),
    _r("NET-MGMT-002", C, "A shared or default SNMP community is written into the design.", (r"community\s+(?:string\s+)?(?:is\s+)?[\"']?(?:public|private)\b", r"read[- ]write\s+community")),
    _r("NET-MGMT-003", H, "Devices are administered in clear text.", (r"\btelnet\b", r"\btftp\b"), unless=(r"(?:telnet|tftp)[^.\n]{0,40}(?:disabled|prohibited|blocked)", r"ssh\s+only"), guard=True),
    _r("NET-MGMT-004", H, "Administrators share accounts or use local ones.", (r"\blocal\s+(?:admin(?:istrator)?\s+)?accounts?\b", r"shared\s+(?:admin|credential|password)"), unless=(r"\btacacs", r"\bradius\b", r"break[- ]glass"), guard=True),
    _r("NET-SEG-001", C, "A rule permits any source to reach any destination.", (r"permit\s+(?:ip\s+)?any\s+any", r"source\s*[:=]?\s*any\b[^.\n]{0,40}dest\w*\s*[:=]?\s*any\b", r"allow\s+all\s+traffic", r"any[- /]any\s+rule"), unless=(r"default\s+deny", r"deny\s+(?:ip\s+)?any\s+any"), guard=True, topics=("segmentation", "wan_edge", "cloud_network")),
    _r("NET-SEG-002", H, "Everything shares one broadcast domain.", (r"flat\s+(?:vlan|network|layer)", r"single\s+(?:vlan|broadcast\s+domain)")),
    _r("NET-HA-001", C, "One device or link is a single point of failure.", (r"single\s+point\s+of\s+failure", r"single\s+(?:uplink|firewall|core\s+switch|router)\b", near(r"\b(?:one|only\s+one|a\s+lone|the\s+only|sole|single)\s+(?:\w+\s+)?(?:router|firewall|switch|circuit|link|uplink|gateway|line)\b", r"\bno\s+(?:backup|standby|second|spare|alternat\w+|redundan\w+|fail-?over)\b|without\s+(?:a\s+)?(?:backup|standby|spare|fail-?over)")), unless=(r"no\s+single\s+point\s+of\s+failure", r"redundant\s+pair")),
    _r("NET-HA-002", C, "Both uplinks end on the same device.", near(r"\b(?:uplink|circuit|fib(?:re|er)|link)s?\b", r"(?:terminat|land|end|connect|arriv)\w*\s+(?:on|in|at|to)\s+(?:the\s+)?(?:same|one|a\s+single)\s+(?:\w+\s+)?(?:switch|device|router|chassis|firewall)") + r"|(?:both|two|dual)\s+uplinks?[^.\n]{0,60}same\s+(?:switch|device|router|chassis)"),
    _r("NET-RTG-001", H, "Routing neighbours are not authenticated.", r"\b(?:ospf|bgp|eigrp|is-is)\b", unless=(r"(?:hmac|sha|md5|keyed)[-\w]*\s+authentication", r"authenticat\w*\s+(?:on|for|of)\s+(?:every|all|each)", r"(?:neighbou?r|routing|md5|hmac)\s+authentication", r"\btcp-ao\b"), guard=True, topics=("routing", "wan_edge")),
    _r("NET-WAN-001", H, "Traffic between sites is not encrypted.", (r"unencrypted\s+(?:wan|mpls|link|circuit)", r"(?:wan|inter-?site)[^.\n]{0,40}(?:without|no)\s+encrypt"), topics=("wan_edge",)),
    _r("NET-WLS-001", H, "Corporate wireless uses a shared key or an old mode.", (r"\bwep\b", r"\bwpa[23]?[- ]?(?:psk|personal)\b", r"pre-?shared\s+key"), unless=(near(r"\bguest\b", r"isolated|internet[- ]only"),), topics=("wireless",)),
    _r("APP-SEC-001", C, "Credentials are embedded in code or configuration.", (r"hard-?coded\s+(?:password|secret|credential|key)", r"\b(?:password|passwd|pwd)\s*[=:]\s*[\"']?\w{6,}", r"\btoken\s*=\s*[\"']?\w{16,}", r"\bAKIA[0-9A-Z]{16}\b"), hard=(rf"{SECRET}[^\n]{{0,90}}?(?:{KEPT})",), unless=(r"(?:fetched|read|injected)\s+from\s+(?:the\s+)?vault",)),
    _r("APP-AUTH-001", C, "An endpoint answers without authentication.", (r"unauthenticated\s+(?:api|endpoint|access)", r"(?:api|endpoint)s?[^.\n]{0,40}(?:without|no)\s+authentication", r"anonymous\s+access", near(r"\b(?:endpoint|api|route|resource|interface|page)s?\b", r"\b(?:needs?|requires?|asks?\s+for|expects?|takes?)\s+no\s+(?:login|log-?in|sign-?in|authentication|credentials?|token|password)\b|\bwithout\s+(?:a\s+)?(?:login|log-?in|logging\s+in|signing\s+in|sign-?in)\b", 60)), hard=(r"\b(?:accept|allow|serve)\w*\s+(?:unauthenticated|anonymous)\s+\w+", near(r"\b(?:webhook|callback)\b", r"without\s+(?:any\s+)?(?:authentication|credentials|a\s+signature)")), unless=(r"oauth", r"mutual\s+tls", r"api\s+key\s+required"), guard=True),
    _r("APP-AUTH-002", H, "Tokens are not verified, do not expire or have no audience.", (r"tokens?[^.\n]{0,30}(?:never|do(?:es)?\s+not)\s+expire", r"signature[^.\n]{0,30}not\s+(?:verified|checked)", r"alg\s*[=:]\s*[\"']?none"), topics=("app_authn_authz", "api_integration")),
    _r("APP-AUTHZ-001", H, "Authorisation is enforced by the client or gateway alone.", (r"(?:client|ui|browser)[- ]side\s+(?:authori[sz]ation|access\s+control)", r"hid(?:es?|den)\s+(?:the\s+)?(?:button|menu)[^.\n]{0,40}role")),
    _r("APP-DATA-001", C, "SQL is built by joining strings.", (r"string\s+concatenation[^.\n]{0,40}(?:sql|quer)", r"dynamic\s+sql", near(r"\b(?:past|glu|append|splic|insert|embed|add)(?:e?d|ing)\s+(?:straight\s+|directly\s+|unchanged\s+)?(?:in)?to\b", r"\bwhere\s+clause|\bsql\b|\b(?:select|query)\s+(?:statement|string|text)\b", 50), near(r"\b(?:concatenat|interpolat)\w+", r"\b(?:sql|quer(?:y|ies)|statement)\b", 70)), unless=(r"parameteri[sz]ed", r"prepared\s+statements?"), guard=True),
    _r("APP-DATA-002", H, "Input is validated in the client only, or not at all.", (r"client[- ]side\s+validation", r"(?:no|without)\s+input\s+validation", r"input[^.\n]{0,20}not\s+validated")),
    _r("APP-TLS-001", C, "Traffic uses plain HTTP or an old TLS.", (r"\bplain(?:text)?\s+http\b", r"\btls\s?1\.[01]\b", r"\bssl\s?v?[23]\b", r"\b(?:over|via)\s+(?:plain\s+|unencrypted\s+)?http\b(?!\s*/\s*[23])", near(r"\bhttp\b", r"without\s+(?:tls|encryption)|unencrypted|in\s+(?:the\s+)?clear", 40), r"http://(?!localhost|127\.)")),
    _r("APP-SDLC-001", M, "No supply-chain scanning is described.", r"\b(?:ci/cd|pipeline|build)\b", (r"(?:no|without)\s+(?:dependency|container|image)\s+scan",), (r"dependency\s+scan", r"\bsbom\b", r"container\s+scan", r"\bsca\b"), guard=True, scope="document"),
    _r("APP-LOG-001", H, "Sensitive data reaches the logs.", (r"log(?:s|ged|ging)?[^.\n]{0,40}(?:password|card\s+number|full\s+request\s+bod)", r"(?:password|token|pii)s?[^.\n]{0,20}(?:are|is)\s+logged")),
    _r("APP-RES-001", M, "External interfaces have no stated rate limit.", r"\b(?:public|external)\s+(?:api|endpoint|interface)s?\b", (), (r"rate[- ]limit", r"throttl", r"\bwaf\b", r"quota"), guard=True, scope="document"),
    _r("SEC-IAM-001", C, "Privileged access lacks a second factor.", r"\b(?:admin(?:istrator)?|privileged|root)\s+(?:access|account|login)s?\b", (r"mfa\s+is\s+(?:optional|not)", r"without\s+(?:mfa|multi-factor)", r"password[- ]only\s+(?:admin|access)"), (r"\bmfa\b", r"multi-factor", r"\bfido2?\b", r"smart\s?cards?"), guard=True, soft_kind="question", topics=("iam_privileged", "zero_trust", "app_authn_authz", "cloud_landing_zone", "network_management", "iac_posture")),
    _r("SEC-IAM-002", H, "People use shared, generic or service accounts.", (r"shared\s+(?:login|user|service)\s+accounts?", r"generic\s+accounts?", near(r"\b(?:common|joint|same)\s+(?:\w+\s+)?(?:user\s?name|login|log-?in|account|credentials?)\b", PEOPLE, 60), r"service\s+account[^.\n]{0,30}used\s+by\s+(?:staff|engineers|operators|humans)")),
    _r("SEC-ZT-001", H, "Being inside the network is taken as trust.", (r"internal\s+(?:network|traffic|users?)\s+(?:is|are)\s+trusted", r"trusted\s+(?:internal\s+)?(?:lan|network)", r"implicit(?:ly)?\s+trust")),
    _r("SEC-CRYPTO-001", H, "A broken algorithm is specified.", (r"\bmd5\b", r"\bsha-?1\b", r"\b(?:3des|des|rc4)\b"), unless=(r"(?:md5|sha-?1|3?des|rc4)[^.\n]{0,30}(?:prohibited|disabled|not\s+used)",)),
    _r("SEC-CRYPTO-002", H, "Keys have no stated custody or rotation.", r"\b(?:encryption|private|signing)\s+keys?\b", (), (r"\bkms\b", r"\bhsm\b", r"rotat", r"escrow", r"key\s+vault"), soft_kind="question", topics=("crypto_keys",)),
    _r("SEC-LOG-001", H, "Security events are not sent to a central place.", r"\b(?:design|architecture|system)\b", (r"(?:no|without)\s+(?:siem|central\s+log)", r"logs?\s+(?:remain|stay|are\s+kept)\s+local"), (r"\bsiem\b", r"central(?:ised|ized)?\s+log", r"log\s+forward", r"\bsyslog\b"), guard=True, scope="document"),
    _r("SEC-LOG-002", M, "Logs are kept too short a time, or no time is stated.", (r"log\s+retention[^.\n]{0,30}(?:tbd|undefined|not\s+defined)", r"retain(?:ed)?\s+(?:for\s+)?(?:\d|[12]\d|30)\s+days")),
    _r("SEC-VULN-001", H, "Unsupported software is part of the target state.", (r"end[- ]of[- ](?:life|support)", r"windows\s+(?:server\s+)?(?:xp|2003|2008|7)\b", r"\bcentos\s?(?:linux\s+)?[5-8]\b", r"\b(?:rhel|red\s+hat\s+enterprise\s+linux)\s?[5-7]\b", r"\bubuntu\s?1[0-8]\.\d\d\b", r"\bpython\s?2(?:\.\d+)?\b", r"\bwindows\s+server\s+2012\b", r"no\s+longer\s+supported"), unless=(r"(?:decommission|replac|migrat)\w*[^.\n]{0,40}end[- ]of", r"upgrade\s+before")),
    _r("SEC-IAM-003", H, "Directory binds are not protected.", (r"ldap\s+simple\s+bind", r"\bldap://", r"simple\s+bind"), unless=(r"\bldaps\b", r"start-?tls", r"channel\s+binding"), guard=True),
    _r("SEC-RES-001", H, "Backups may be altered, or restores are untested.", r"\bback-?ups?\b", (near(r"\bback-?ups?\b", r"\bsame\s+(?:subscription|account|project|tenant|site|building|rack|server|host|volume|disk)\b"),), (r"immutab", r"offline\s+cop", r"air[- ]gap", r"restore\s+test", r"tested\s+restore"), kind="question"),
    _r("SEC-TM-001", M, "No threat model accompanies the design.", r"\b(?:design|architecture|system)\b", (r"threat\s+model[^.\n]{0,40}(?:not|yet|future)",), (r"threat\s+model", r"\bstride\b", r"attack\s+surface", r"attack\s+tree"), guard=True, scope="document"),
    _r("CLD-STOR-001", C, "Storage or a database can be reached by the public.", (r"public(?:ly)?\s+(?:accessible|readable|reachable)\s+(?:bucket|storage|database|blob)", r"public\s+(?:bucket|blob\s+container)", near(STORE, r"public(?:ly)?\s+(?:read|access|accessible|readable|reachable|writ\w+)\b|anonymous\s+read")), (r"(?:bucket|database|blob)s?[^.\n]{0,30}(?:open\s+to|reachable\s+from)\s+the\s+internet", near(STORE, r"\b(?:anyone|anybody|everyone|everybody)\b[^.\n]{0,40}\b(?:read|download|list|fetch|open|see)\b|\b(?:read|download|list|open)\w*\s+(?:by|for|to)\s+(?:anyone|anybody|everyone|the\s+(?:whole\s+)?(?:public|world))")), (r"public\s+access\s+(?:is\s+|stays\s+)?(?:blocked|disabled|denied|prevented|off)", r"block\s+public\s+access", r"private\s+endpoint"), guard=True),
    _r("CLD-ENC-001", H, "Data at rest is not encrypted with own keys.", (r"(?:no|without|unencrypted)[^.\n]{0,20}at\s+rest", r"provider[- ]managed\s+keys?"), topics=("data_protection", "data_classification")),
    _r("CLD-LZ-001", H, "Production and other workloads share an account.", (r"(?:production|prod)\s+and\s+(?:non-?prod\w*|test|dev\w*)[^.\n]{0,40}(?:same|single|one)\s+(?:account|subscription|project)", r"single\s+(?:account|subscription)\s+for\s+all", near(r"\b(?:one|single|same|shared)\s+(?:\w+\s+)?(?:subscription|account|project)\b", r"\bprod(?:uction)?\b[^.\n]{0,30}\b(?:test|dev\w*|staging|sandbox|non-?prod\w*)\b|\b(?:test|dev\w*|staging|sandbox)\b[^.\n]{0,30}\bprod(?:uction)?\b", 60))),
    _r("CLD-IAM-001", C, "Workloads have wildcard permissions.", (r"[\"']?action[\"']?\s*[:=]\s*[\"']\*", r"administratoraccess", r"wildcard\s+(?:iam|permission)", r"owner\s+role\s+(?:on|at)\s+(?:the\s+)?subscription")),
    _r("CLD-NET-001", H, "Management or database ports face the internet.", (r"0\.0\.0\.0/0[^.\n]{0,40}(?:22|3389|1433|3306|5432)\b", r"(?:22|3389|1433|3306|5432)\b[^.\n]{0,40}0\.0\.0\.0/0"), topics=("cloud_network", "segmentation")),
    _r("CLD-DATA-001", H, "Sensitive data is handled without stated protection.", r"\b(?:pii|personal\s+data|cardholder|health\s+records?)\b", (r"(?:pii|personal\s+data)[^.\n]{0,40}(?:unencrypted|in\s+clear|without\s+mask)",), (r"classif", r"\bmask", r"tokeni[sz]", r"encrypt"), guard=True, soft_kind="question", topics=("data_classification", "data_protection")),
    _r("CLD-IAC-001", M, "Infrastructure is built by hand or not scanned.", (r"(?:manually|by\s+hand)\s+provision", r"provision\w*\s+(?:manually|by\s+hand|through\s+the\s+console)"), unless=(r"terraform\s+plan", r"policy\s+as\s+code"), topics=("iac_posture", "cloud_landing_zone")),
    _r("SEC-EXC-001", H, "A control is relaxed for convenience.", hard=(r"(?:disabled|relaxed|bypassed|waived)[^.\n]{0,60}(?:because|due\s+to|to\s+(?:avoid|simplify|reduce))", r"temporar(?:y|ily)[^.\n]{0,30}(?:exception|disabled)", near(r"\b(?:certificate|hostname|host\s+key|peer|signature|tls)\s+(?:check|validation|verification|pinning)\w*", OFF, 90), r"(?:publicly\s+accessible|left\s+open|lifted|exempted)\b[^.\n]{0,40}\bso\s+that\b")),
    _r("APP-AUTHZ-002", H, "Object identifiers can be guessed.", (r"sequential\s+(?:id|identifier|number)s?",), (r"(?:id|identifier)\s+in\s+the\s+url[^.\n]{0,40}not\s+checked", r"incrementing\s+(?:id|identifier)s?", r"\b(?:id|identifier|number)s?\b[^.\n]{0,40}\b(?:are|is)\s+(?:sequential|consecutive|incrementing|counted\s+up)\b"), (r"ownership\s+check", r"object[- ]level\s+authori[sz]ation"), soft_kind="question"),
    _r("SEC-IAM-004", H, "A whole population is given access.", hard=(r"\b(?:all|every|any)\s+(?:signed-in\s+|authenticated\s+)?(?:staff|employees?|users?|agents?|domain\s+users)\b[^.\n]{0,60}(?:\bcan\s+(?:issue|export|approve|delete|read|edit|create|access)|access|write|permission)", r"(?:assigned|granted|open)\s+to\s+(?:the\s+)?(?:all\s+(?:staff|employees|users)|everyone|domain\s+users|authenticated\s+users)\b")),
    _r("NET-EXPO-001", C, "Remote administration faces any source.", hard=(r"\b(?:rdp|vnc|ssh|telnet)\b[^.\n]{0,50}(?:from\s+any(?:where)?|open\s+to\s+the\s+internet|0\.0\.0\.0/0)",)),
    _r("NET-SEG-003", H, "All traffic may pass between zones of different trust.", hard=(r"all\s+(?:traffic|ports|protocols)\s+(?:is|are)\s+(?:allowed|permitted)\s+between", r"unrestricted\s+(?:traffic|access)\s+between", r"\b(?:permits?|allows?|lets?|passes?)\s+all\s+(?:traffic|ports|protocols|packets)\b[^.\n]{0,30}\bbetween\b")),
    _r("CLD-K8S-001", H, "The control plane's endpoint is public.", hard=r"\b(?:kubernetes|k8s|aks|eks|gke|cluster)\s+(?:api|control\s+plane)\b[^.\n]{0,40}\bpublic(?:ly)?\b", unless=r"private\s+(?:cluster|endpoint)"),
    _r("NET-EGR-001", M, "Outbound access is unrestricted.", near(r"\b(?:open|make|initiate|establish|start)\w*\s+(?:outbound\s+)?(?:connection|session)s?\b|\b(?:reach|contact|connect\s+to)\b", r"\b(?:any|every)\s+(?:host|address|destination|site|server)\w*\s+(?:on|out\s+on|in)\s+the\s+(?:public\s+)?internet", 60), unless=(r"\b(?:can\s?not|can't|must\s+not|may\s+not|never|nothing|none)\b",), hard=(r"(?:unrestricted|open)\s+(?:outbound|egress)", r"(?:outbound|egress)\b[^.\n]{0,70}(?:unrestricted|allow(?:ed)?\s+(?:all|any))")),
    _r("APP-SESS-001", H, "Sessions outlive sign-out or a changed password.", hard=(r"(?:session|token)s?\s+(?:remain|stay)s?\s+valid[^.\n]{0,60}(?:log\w*[- ]?out|sign\w*[- ]?out|password)", r"not\s+(?:revoked|invalidated)\s+(?:on|after|at)\s+(?:log-?out|sign-?out)")),
    _r("SEC-PKI-001", C, "A signing key is held as a file.", hard=(r"(?:ca|code[- ]signing|firmware)\s+(?:private\s+)?key[^\n]{0,60}?(?:laptop|workstation|file\s+share|repository|file)", near(r"\b(?:ca|certificate\s+authority|signing|firmware)\s+(?:private\s+)?keys?\b", r"\b(?:usb|thumb|flash)\s*(?:stick|drive|key)|\bremovable\b|\.(?:pfx|p12|pem)\b", 70)), unless=(r"\bhsm\b", r"key\s+ceremony"), guard=True),
    _r("SEC-PKI-002", M, "Certificates live for decades.", hard=r"(?:certificate|credential)s?[^.\n]{0,40}(?:valid|lifetime)[^.\n]{0,20}\b(?:[1-9]\d)\s+years"),
    _r("APP-CICD-001", H, "Untrusted code runs on shared build machines.", hard=(r"\bforks?\b[^.\n]{0,60}\brun\w*\b[^.\n]{0,60}\b(?:shared|self-hosted|persistent)\s+(?:runner|agent)s?", r"self-hosted\s+runners?[^.\n]{0,40}(?:public|fork)", r"(?:token|secret|credential|variable)s?\b[^.\n]{0,60}(?:available|exposed|visible)\s+to\s+(?:all|every|any)\s+(?:\w+\s+)?(?:job|pipeline|branch|stage)"), unless=(r"maintainer\s+approval", r"ephemeral\s+(?:runner|agent)")),
    _r("APP-CICD-002", H, "Dependencies may come from a public index.", hard=(r"(?:extra-index-url|public\s+(?:npm|pypi|index))[^.\n]{0,60}(?:internal|private)", r"(?:internal|private)\s+(?:registry|index)[^.\n]{0,40}fall(?:s)?\s*back")),
    _r("APP-CICD-003", M, "Deployments use tags that may move.", hard=(r":latest\b", r"mutable\s+(?:image\s+)?tags?", r"latest\s+tag", near(r"\b(?:image\s+|release\s+)?tags?\b", r"\b(?:is|are|gets?|may\s+be|can\s+be)\s+(?:overwritten|re-?used|re-?pointed|moved)\b", 40)), unless=(r"pinned\s+(?:by|to)\s+digest", r"immutable\s+tags?"), guard=True),
    _r("OT-FW-001", H, "Firmware arrives without a check of its source.", hard=(r"\b(?:firmware|update|package|image)s?\b[^.\n]{0,50}(?:over|via)\s+(?:plain\s+|unencrypted\s+)?http\b", r"firmware[^.\n]{0,40}(?:unsigned|not\s+signed|without\s+signature)")),
    _r("OT-DBG-001", H, "A debug port stays enabled in production.", hard=(r"\b(?:jtag|uart|debug\s+(?:port|interface))\b[^.\n]{0,40}(?:enabled|left|open)", r"root\s+console[^.\n]{0,30}(?:enabled|available)"), unless=r"(?:fused|disabled)\s+(?:in|for|on)\s+production", guard=True),
    _r("APP-UPLOAD-001", H, "Uploads of any type are taken unchecked.", hard=(r"(?:any|all|arbitrary)\s+file\s+(?:types?|formats?|extensions?)", r"upload[^.\n]{0,40}(?:without|no)\s+(?:validation|scan)", near(r"\b(?:attach|upload|file|document)\w*", r"\b(?:whatever|any|every|arbitrary)\s+(?:file\s+|mime\s+|content\s+)?(?:extension|type|format|kind)s?\b", 60)), unless=(r"malware\s+scan", r"antivirus", r"content[- ]type\s+check", r"allow-?list")),
    _r("APP-SSRF-001", H, "The service fetches an address that a caller gives.", hard=(r"fetch(?:es)?[^.\n]{0,30}(?:user|caller|client)[- ]supplied\s+url", r"url\s+(?:supplied|provided)\s+by\s+the\s+(?:user|caller|client)", near(r"\b(?:fetch|download|retriev|load|request|call|pull|open)\w*", r"\b(?:whichever|whatever|any|the)\s+(?:web\s+)?(?:address|url|link|host)(?:es|s)?\b[^.\n]{0,30}\b(?:user|caller|client|visitor|customer|member|guest|patient|reader)s?\s+(?:type|enter|suppl|provide|paste|give|choose|submit|send)\w*", 60)), unless=r"allow-?list"),
    _r("APP-PWD-001", M, "Short passwords are allowed.", hard=r"(?:minimum|at\s+least)\s+(?:password\s+length\s+(?:of\s+|is\s+)?)?(?:four|five|six|seven|\b[4-7])\s+characters"),
)
