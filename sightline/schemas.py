"""Schemas and fixed values shared by every operator.

A *sighting* (observation) row carries ``facts``: an array of one-key unions,
one nullable sub-struct per fact kind.  On the wire a MAC is six integers; once
ingested it is canonical lower-case colon text, so joins and aggregates on it
are plain string operations.
"""

from __future__ import annotations

# The closed list of fact kinds, in their declared order.
FACT_KINDS = ["Mac", "IpV4", "Hostname", "DhcpLease", "Uplink", "OuiVendor", "Rtt"]

# Field names under which three kinds can be declared by hand.
DECLARABLE = {"IpV4": "ipv4", "Hostname": "hostname", "Mac": "mac"}

# Error codes a source may report.
ERROR_CODES = [
    "Unauthorized",
    "Unreachable",
    "SchemaMismatch",
    "Timeout",
    "RemoteFault",
    "Misconfigured",
    "Cancelled",
]

# Hostname origins.
HOSTNAME_SOURCES = ["Dhcp", "Dns", "Mdns", "Netbios", "Other"]

# Verdicts a rule may return for a pair.
DISQUALIFYING = "Disqualifying"
DECISIVE = "Decisive"
SUPPORTS = "Supports"
OPPOSES = "Opposes"
NEUTRAL = "Neutral"

# Rule ids of the scoped-key level.
EXACT_MAC = "l1-exact-mac"
DISTINCT_MAC = "l1-distinct-mac"
L1_PREFIX = "l1-"

# Decision outcomes and abstention causes.
MATCH = "match"
NO_MATCH = "no_match"
ABSTAINED = "abstained"
AMBIGUOUS = "ambiguous"
ABSENCE_OF_PROOF = "absence_of_proof"

# What a declared field may abstain on.
OUT_OF_PERIMETER = "OutOfPerimeter"
CONFLICTING = "ConflictingObservations"
NO_VALUE = "NoObservedValue"

# Versioned-link vocabulary.
ENGINE = "ENGINE"
OPERATOR = "OPERATOR"
NIL_ID = "00000000-0000-0000-0000-000000000000"
OPEN_END = "9999-12-31 23:59:59.999999"
RULESET_VERSION = 1

# Labelled expectations.
MUST_MERGE = "must-merge"
MUST_NOT_MERGE = "must-not-merge"
MUST_ABSTAIN = "must-abstain"

WIRE_FACT = (
    "struct<Mac:struct<addr:array<int>,locally_administered:boolean>,"
    "IpV4:struct<addr:string>,"
    "Hostname:struct<name:string,source:string>,"
    "DhcpLease:struct<ip:string,expires_at:timestamp>,"
    "Uplink:struct<peer_mac:array<int>,peer_port:string>,"
    "OuiVendor:struct<vendor:string>,"
    "Rtt:struct<millis:bigint>>"
)

WIRE_RECORD = (
    "record string, obs_id string, connector_id string, observed_at timestamp, "
    "scope struct<l2_domain:string,vantage:string>, "
    f"facts array<{WIRE_FACT}>, raw string, as_of timestamp, kinds array<string>, "
    "error string, _corrupt string"
)

# The only keys a line may carry, by record kind.
OBSERVATION_KEYS = ["obs_id", "connector_id", "observed_at", "scope", "facts", "raw"]
CAPABILITY_KEYS = ["record", "as_of", "kinds"]
FAILURE_KEYS = ["record", "error"]
SCOPE_KEYS = ["l2_domain", "vantage"]

LINK_COLUMNS = [
    "link_id",
    "observation_id",
    "interface_id",
    "current_subject",
    "outcome",
    "rule_id",
    "abstention_cause",
    "evidence",
    "ruleset_version",
    "decided_by",
    "valid_from",
    "valid_to",
]

INTERFACE_COLUMNS = ["interface_id", "l2_domain", "mac", "first_seen_at", "last_seen_at"]
