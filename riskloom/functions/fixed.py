"""Fixed values of the exposure model, and small helpers that turn them into expressions, tables and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------

# Which zones a zone reaches.
ZONE_REACH = """
dmz: dmz prod-web corp
internet: dmz
prod-web: prod-web prod-app dmz
prod-app: prod-app prod-db prod-web corp restricted
prod-db: prod-db prod-app restricted
dev-web: dev-web dev-app corp staging
dev-app: dev-app dev-db dev-web corp
dev-db: dev-db dev-app
staging: staging prod-web dev-web dev-app
corp: corp corp-wifi prod-web prod-app dev-web dev-app mgmt dmz
corp-wifi: corp-wifi corp
restricted: restricted prod-db prod-app pci hipaa mgmt security
pci: pci restricted
hipaa: hipaa restricted
mgmt: mgmt security corp restricted
security: security mgmt restricted
cloud-prod: cloud-prod prod-web prod-app cloud-dev
cloud-dev: cloud-dev dev-web dev-app cloud-prod
dr: dr restricted prod-db
internal: internal restricted dmz prod-web prod-app prod-db corp
"""

# The short list of zone kinds.
ZONE_REACH_COARSE = """
dmz: internal dmz
internal: internal restricted dmz
restricted: restricted internal
airgap: airgap
cloud: cloud dmz internal
unknown: unknown dmz internal
"""

# Techniques in order: edge type, base prior, display name.
TECHNIQUES = """
exploit 0.30 Initial Access
lateral 0.40 Lateral Movement
credential_theft 0.50 Credential Theft
privilege_escalation 0.25 Privilege Escalation
data_exfiltration 0.15 Data Exfiltration
"""

# Threat profiles: multipliers of the priors.
PROFILES = """
apt: credential_theft 1.6 lateral 1.3 privilege_escalation 1.4 exploit 0.8 data_exfiltration 1.2
ransomware: exploit 1.6 lateral 1.5 data_exfiltration 1.8 credential_theft 1.2 privilege_escalation 1.1
insider: privilege_escalation 1.8 data_exfiltration 1.6 lateral 0.6 credential_theft 0.7 exploit 0.4
"""

# Finding categories and the techniques they serve; other categories serve all.
CATEGORY_TECHNIQUES = """
network: lateral exploit credential_theft
authentication: credential_theft privilege_escalation
authorization: privilege_escalation data_exfiltration
service: exploit lateral
encryption: data_exfiltration
"""

# Affinity of techniques to target types (or zones): technique, factor, targets.
AFFINITY_TYPES = """
credential_theft 1.5 domain_controller identity_server
credential_theft 1.25 jump_server email_server
privilege_escalation 1.4 domain_controller
privilege_escalation 1.3 pki_server ca_server identity_server
exploit 1.2 web_server app_server
data_exfiltration 1.3 database_server backup_server file_server
"""
AFFINITY_ZONES = "lateral 1.3 restricted security mgmt"
SENSITIVE_ZONES = "restricted mgmt security pci hipaa dr"
TARGETS_SURE = "domain_controller identity_server pki_server ca_server key_management"
TARGETS_POSSIBLE = "backup_server file_server jump_server bastion secrets_manager hsm privileged_access_workstation"
TARGETS_LIKELY = "backup_server secrets_manager hsm bastion"

# Tiers of asset types; other types are of tier 2.
TIERS = """
1: workstation laptop printer scanner iot_device voip_phone voip_server developer_workstation
2: web_server file_server app_server application_server proxy_server reverse_proxy vpn_gateway firewall
2: load_balancer web_application_firewall api_gateway microservice dns_server dhcp_server nas chat_server
2: monitoring logging_server build_server code_repo artifact_repo container_registry k8s_cluster storage_server
3: database_server nosql_db data_warehouse email_server backup_server siem pam nosql jump_server
4: domain_controller active_directory identity_server pki_server certificate_authority
4: privileged_access_workstation admin_workstation bastion_host pci_server hipaa_server
"""
TERMINAL_TYPES = "domain_controller active_directory identity_server pki_server certificate_authority bastion_host pci_server hipaa_server"

# Kill-chain phases and capabilities by edge type.
PHASES = """
exploit: Weaponization, Delivery, Exploitation
lateral: Installation, Command & Control, Lateral Movement
credential_theft: Credential Access
privilege_escalation: Privilege Escalation
data_exfiltration: Collection, Exfiltration
"""
CAPABILITIES = """
exploit: Exploit Development, Vulnerability Research
lateral: Network Traversal, Post-Exploitation
credential_theft: Credential Harvesting
privilege_escalation: Privilege Escalation
data_exfiltration: Data Exfiltration
"""

# Feature vector: asset types, zones, sensitivities.
FEATURE_TYPES = "domain_controller file_server web_server database_server app_server workstation jump_server email_server backup_server other"
FEATURE_ZONES = "dmz prod-web prod-app prod-db dev-web dev-app dev-db staging corp corp-wifi restricted pci hipaa mgmt security cloud-prod cloud-dev dr"
SENSITIVITY = "credentials 1.0 pii 0.9 financial 0.85 user_files 0.6 business_logic 0.7 user_data 0.5"

# Zone detection rules in order: kind, pattern, zone, confidence.
ZONE_RULES = r"""
cidr 192.168.0.0/24 dmz 0.9
cidr 10.0.0.0/24 dmz 0.8
cidr 10.1.0.0/16 internal 0.9
cidr 10.2.0.0/16 internal 0.9
cidr 10.10.0.0/16 restricted 0.9
cidr 10.100.0.0/16 restricted 0.9
cidr 10.255.0.0/16 airgap 0.95
hostname ^dmz- dmz 0.85
hostname ^ext- dmz 0.8
hostname ^web\d dmz 0.7
hostname ^dc\d restricted 0.8
hostname ^db\d restricted 0.75
hostname ^corp- internal 0.8
hostname ^ws- internal 0.7
service iis dmz 0.6
service nginx dmz 0.6
service apache dmz 0.6
service active-directory restricted 0.7
service sql-server restricted 0.7
cloud aws cloud 0.9
cloud azure cloud 0.9
cloud gcp cloud 0.9
"""
VLANS = """
dmz: 10 20 30
internal: 100 101 102 200 201
restricted: 500 501 502 600
airgap: 900 901
"""
VLAN_CONFIDENCE = 0.85

# --- readers --------------------------------------------------------------------------------------------------


def groups(text: str) -> list[tuple[str, list[str]]]:
    """('dmz', ['dmz', 'prod-web']) of each 'dmz: dmz prod-web' line."""
    return [(k.strip(), v.replace(",", " ").split()) for k, v in (x.split(":", 1) for x in text.strip().splitlines())]


def phrases(text: str) -> dict[str, list[str]]:
    return {k.strip(): [p.strip() for p in v.split(",")] for k, v in (x.split(":", 1) for x in text.strip().splitlines())}


def techniques() -> list[tuple[str, float, str]]:
    return [(a, float(b), c) for a, b, c in (x.split(None, 2) for x in TECHNIQUES.strip().splitlines())]


def profiles() -> dict[str, dict[str, float]]:
    return {k: dict(zip(v[::2], map(float, v[1::2]))) for k, v in groups(PROFILES)}


def reach() -> list[tuple[str, str]]:
    """(source zone, target zone) of all reaching pairs, every zone with itself."""
    pairs = [(a, b) for a, bs in groups(ZONE_REACH) for b in bs]
    return sorted({*pairs, *((a, a) for a, _ in groups(ZONE_REACH))})


def zone_distances() -> dict[tuple[str, str], int]:
    """Hops between zones over the reach table, breadth first; pairs without a way are absent."""
    near = dict(groups(ZONE_REACH))
    out: dict[tuple[str, str], int] = {}
    for start in near:
        ring, hops = {start}, 0
        while ring:
            fresh = {z for z in ring if (start, z) not in out}
            out |= {(start, z): hops for z in fresh}
            ring, hops = {n for z in fresh for n in near.get(z, [])}, hops + 1
    return out


def zone_rules(kind: str) -> list[tuple[int, str, str, float]]:
    rows = [x.split() for x in ZONE_RULES.strip().splitlines()]
    return [(i, p, z, float(c)) for i, (k, p, z, c) in enumerate(rows) if k == kind]


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of a block as numbers; /0 is everything."""
    net, bits = cidr.split("/")
    a, b, c, d = map(int, net.split("."))
    size = 1 << (32 - int(bits))
    low = (((a * 256 + b) * 256 + c) * 256 + d) // size * size
    return low, low + size - 1


# --- expressions and SQL --------------------------------------------------------------------------------------


def switch(c: Column, table: dict[str, float | int | str], default) -> Column:
    """The entry of a small fixed table, as a chain of conditions (stays in generated code)."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table; its size is that of the text above, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """'(VALUES ...) name(columns)' of SQL."""
    body = ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else quoted(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) {name}({columns})"


def sql_case(column: str, table: dict, default) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {f'CAST({v!r} AS DOUBLE)' if isinstance(v, float) else quoted(v)}" for k, v in table.items())
    return f"(CASE {column} {arms} ELSE {f'CAST({default!r} AS DOUBLE)' if isinstance(default, float) else quoted(default)} END)"


def tiers() -> dict[str, int]:
    return {t: int(k) for k, v in groups(TIERS) for t in v}


def pairs_of(text: str) -> dict[str, float]:
    parts = text.split()
    return dict(zip(parts[::2], map(float, parts[1::2])))
