"""Checks.  Each returns the offending rows; a strict caller raises on the first.

Stream checks yield (stream, seq, rule, detail) with ``detail`` as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions import address as A
from sightline.functions.facts import is_locally_administered, kind_of, once_per_row, open_end
from sightline.plans.ordering import running_last, running_max
from sightline.plans.skew import lookup
from sightline.sources import wire


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _violation(df: DataFrame, rule: str, detail: Column | str) -> DataFrame:
    return df.select("stream", "seq", F.lit(rule).alias("rule"), _text(detail).alias("detail"))


# ---------------------------------------------------------------- lines

# Keys a fact of each kind may carry.
FACT_KEYS = {
    "Mac": ["addr", "locally_administered"],
    "IpV4": ["addr"],
    "Hostname": ["name", "source"],
    "DhcpLease": ["ip", "expires_at"],
    "Uplink": ["peer_mac", "peer_port"],
    "OuiVendor": ["vendor"],
    "Rtt": ["millis"],
}


def _strange_nested_key() -> Column:
    """A key inside scope or a fact that the schema does not know; from_json would drop it."""
    known = F.create_map(
        *[x for k, ks in FACT_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, ks)))]
    )

    def strange(entry: Column) -> Column:
        inner = F.array_except(
            F.json_object_keys(entry["value"]), F.try_element_at(known, entry["key"])
        )
        return F.coalesce(F.size(inner) > 0, F.lit(False))

    in_scope = F.size(F.array_except("_scope_keys", F.array(*map(F.lit, S.SCOPE_KEYS)))) > 0
    in_facts = F.exists("_boxes", lambda m: F.exists(F.map_entries(m), strange))
    return F.coalesce(in_scope, F.lit(False)) | F.coalesce(in_facts, F.lit(False))


# JSON types of each fact kind, members by name, as a variant's schema prints them.
_MAC = "ARRAY<BIGINT>"
FACT_SHAPES = {
    "DhcpLease": r"OBJECT<(expires_at: (STRING|VOID), )?ip: STRING>",
    "Hostname": "OBJECT<name: STRING, source: STRING>",
    "IpV4": "OBJECT<addr: STRING>",
    "Mac": f"OBJECT<addr: {_MAC}, locally_administered: BOOLEAN>",
    "OuiVendor": "OBJECT<vendor: STRING>",
    "Rtt": "OBJECT<millis: BIGINT>",
    "Uplink": f"OBJECT<peer_mac: {_MAC}, peer_port: STRING>",
}
ERROR_SHAPES = {
    "Unauthorized": "OBJECT<detail: STRING>",
    "Unreachable": "OBJECT<detail: STRING>",
    "Misconfigured": "OBJECT<detail: STRING>",
    "SchemaMismatch": r"OBJECT<detail: STRING(, os_version_hint: (STRING|VOID))?>",
    "RemoteFault": "OBJECT<detail: STRING, status: BIGINT>",
}
BARE_ERRORS = ["Timeout", "Cancelled"]
_FACTS = "|".join(f"{k}: {v}" for k, v in FACT_SHAPES.items())
_ERRORS = "|".join(f"OBJECT<{k}: {v}>" for k, v in ERROR_SHAPES.items())
OBSERVATION_SHAPE = (
    rf"^OBJECT<connector_id: STRING, facts: ARRAY<(VOID|OBJECT<(({_FACTS})(, )?)+>)>, obs_id: STRING, "
    r"observed_at: STRING, (raw: (STRING|VOID), )?scope: OBJECT<l2_domain: STRING, vantage: STRING>>$"
)
CAPABILITY_SHAPE = r"^OBJECT<as_of: STRING, kinds: ARRAY<(STRING|VOID)>, record: STRING>$"
FAILURE_SHAPE = rf"^OBJECT<error: (STRING|{_ERRORS}), record: STRING>$"
ID_PATTERN = r"^[0-9A-Za-z_.:-]+$"


def _bad_fact(f: Column) -> Column:
    """Whether a fact is not one kind, lacks a member, or holds a value outside its range."""
    def bad_mac(octets: Column) -> Column:
        return (F.size(octets) != 6) | F.exists(octets, lambda o: o.isNull() | (o < 0) | (o > 255))

    def lacks(box: Column, *members: str) -> Column:
        return reduce(lambda a, b: a | b, [box[m].isNull() for m in members])

    lease, name, mac, up = f["DhcpLease"], f["Hostname"], f["Mac"], f["Uplink"]
    tests = {
        "DhcpLease": lacks(lease, "ip") | ~A.is_ipv4(lease["ip"])
        | (lease["expires_at"].isNotNull() & wire.utc(lease["expires_at"]).isNull()),
        "Hostname": lacks(name, "name", "source") | ~name["source"].isin(S.HOSTNAME_SOURCES),
        "IpV4": lacks(f["IpV4"], "addr") | ~A.is_ipv4(f["IpV4"]["addr"]),
        "Mac": lacks(mac, "addr", "locally_administered") | bad_mac(mac["addr"]),
        "OuiVendor": lacks(f["OuiVendor"], "vendor"),
        "Rtt": lacks(f["Rtt"], "millis") | (f["Rtt"]["millis"] < 0) | (f["Rtt"]["millis"] > 4294967295),
        "Uplink": lacks(up, "peer_mac", "peer_port") | bad_mac(up["peer_mac"]),
    }
    kinds = reduce(lambda a, b: a + b, [f[k].isNotNull().cast("int") for k in S.FACT_KINDS])
    wrong = F.lit(False)
    for kind, test in tests.items():
        wrong = wrong | F.coalesce(f[kind].isNotNull() & test, F.lit(False))
    return F.coalesce((kinds != 1) | wrong, F.lit(True))


def _bad_error(raw: Column, status: Column) -> Column:
    boxed = raw.startswith("{")
    outside = F.coalesce((status < 0) | (status > 65535), F.lit(False))
    return F.when(boxed, outside).otherwise(~raw.isin(BARE_ERRORS))


def line_shape(lines: DataFrame, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Lines that are no record: malformed, both or neither tag, unknown keys, wrong types or values.

    Only an empty line is passed over; spaces alone are malformed.  Types are those of the JSON text,
    not what they could be read as; closed lists and ranges are checked.
    """
    tagged = lines.where("line <> ''").select(
        "stream",
        "seq",
        once_per_row(
            _shape=F.schema_of_variant(F.try_parse_json("line")),
            _keys=F.json_object_keys("line"),
            _r=F.from_json("line", wire.LINE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}),
            _scope_keys=F.json_object_keys(F.get_json_object("line", "$.scope")),
            _boxes=F.from_json(
                F.get_json_object("line", "$.facts"), "array<map<string,string>>"
            ),
            _status=F.get_json_object("line", "$.error.RemoteFault.status").try_cast("bigint"),
        ),
    )
    has = lambda k: F.array_contains("_keys", k)
    kind = F.col("_r.record")
    allowed = (
        F.when(has("obs_id"), F.array(*map(F.lit, S.OBSERVATION_KEYS)))
        .when(kind == "capability", F.array(*map(F.lit, S.CAPABILITY_KEYS)))
        .when(kind == "failure", F.array(*map(F.lit, S.FAILURE_KEYS)))
    )
    needed = (
        F.when(has("obs_id"), F.array(*map(F.lit, S.OBSERVATION_KEYS[:-1])))
        .when(kind == "capability", F.array(*map(F.lit, S.CAPABILITY_KEYS)))
        .when(kind == "failure", F.array(*map(F.lit, S.FAILURE_KEYS)))
    )
    shape = F.col("_shape")
    bad_kind = F.exists("_r.kinds", lambda k: k.isNull() | ~k.isin(S.FACT_KINDS))
    wrong = (
        F.when(
            has("obs_id"),
            ~shape.rlike(OBSERVATION_SHAPE)
            | ~F.col("_r.obs_id").rlike(id_pattern)
            | ~F.col("_r.connector_id").rlike(id_pattern)
            | wire.utc(F.col("_r.observed_at")).isNull()
            | F.exists("_r.facts", _bad_fact),
        )
        .when(
            kind == "capability",
            ~shape.rlike(CAPABILITY_SHAPE) | wire.utc(F.col("_r.as_of")).isNull() | bad_kind,
        )
        .otherwise(~shape.rlike(FAILURE_SHAPE) | _bad_error(F.col("_r.error"), F.col("_status")))
    )
    wrong_type = F.col("_r._corrupt").isNotNull() | F.coalesce(wrong, F.lit(True))
    rule = (
        F.when(shape.isNull(), "malformed")
        .when(F.col("_keys").isNull(), "unrecognised")
        .when(has("obs_id") & has("record"), "ambiguous")
        .when(~has("obs_id") & ~has("record"), "unrecognised")
        .when(allowed.isNull(), "control_record")
        .when(F.size(F.array_except("_keys", allowed)) > 0, "unknown_key")
        .when(_strange_nested_key(), "unknown_key")
        .when(F.size(F.array_except(needed, F.col("_keys"))) > 0, "missing_key")
        .when(wrong_type, "wrong_type")
    )
    return tagged.select("stream", "seq", rule.alias("rule")).where("rule is not null")


def roundtrip(lines: DataFrame) -> DataFrame:
    """Lines that writing the parsed record again does not reproduce."""
    again = wire.parse_lines(lines).withColumn("_again", wire.record_json())
    return _violation(again.where(~F.col("_again").eqNullSafe(F.col("line"))), "roundtrip", "record")


# ---------------------------------------------------------------- streams


def after_terminal_failure(feed: DataFrame) -> DataFrame:
    """Records behind the first failure of their stream."""
    ends = feed.groupBy("stream").agg(
        F.count("*").alias("_n"), F.min(F.when(F.col("record") == "failure", F.col("seq"))).alias("_end")
    )
    rows = feed.select("stream", "seq")
    behind = lookup(rows, ends, ["stream"], "_n", "seq").where("seq > _end")
    return _violation(behind, "after_terminal_failure", "_end")


def scripted_cancel(feed: DataFrame) -> DataFrame:
    """Cancellation comes from the runtime, never from data."""
    found = feed.where((F.col("record") == "failure") & (F.col("error_code") == "Cancelled"))
    return _violation(found, "scripted_cancel", "error_code")


def duplicate_obs(feed: DataFrame) -> DataFrame:
    """Ids repeated in one stream: the second line, with the first as detail.

    The ranked window is limited to two rows, so a much repeated id sends two
    rows per map task.
    """
    ranked = Window.partitionBy("stream", "obs_id").orderBy("seq")
    pair = (
        feed.where("obs_id is not null")
        .select("stream", "obs_id", "seq", F.row_number().over(ranked).alias("_rank"))
        .where("_rank <= 2")
        .groupBy("stream", "obs_id")
        .agg(F.min("seq").alias("_first"), F.max("seq").alias("seq"))
        .where("seq > _first")
    )
    return _violation(pair, "duplicate_obs", "_first")


def foreign_connector(feed: DataFrame, owners: DataFrame) -> DataFrame:
    """Sightings of a connector other than their stream's; ``owners`` is (stream, owner)."""
    rows = feed.where("record = 'observation'").select("stream", "seq", "connector_id")
    weights = rows.groupBy("stream").agg(F.count("*").alias("_n"))
    held = lookup(rows, owners, ["stream"], "_n", "seq", weights=weights)
    return _violation(held.where("connector_id <> owner"), "foreign_connector", "connector_id")


def uncovered_scope(feed: DataFrame, covered: DataFrame) -> DataFrame:
    """Sightings outside the scopes their stream covers; ``covered`` has one row per scope."""
    scope = ["stream", "l2_domain", "vantage"]
    rows = feed.where("record = 'observation'").select(*scope, "seq")
    weights = rows.groupBy(*scope).agg(F.count("*").alias("_n"))
    known = covered.select(*scope).distinct().withColumn("_covered", F.lit(True))
    out = lookup(rows, known, scope, "_n", "seq", how="left", weights=weights)
    return _violation(
        out.where("_covered is null"),
        "uncovered_scope",
        F.concat_ws("/", _text("l2_domain"), _text("vantage")),
    )


def capability_in_force(feed: DataFrame, initial: list[str] | None = None) -> DataFrame:
    """Each sighting with the kinds its stream could see at that place in it."""
    start = F.array(*[F.lit(k) for k in (S.FACT_KINDS if initial is None else initial)])
    start = start.cast("array<string>")
    slim = feed.select("stream", "seq", "record", "obs_id", "facts", "kinds")
    found = running_last(slim, ["stream"], "seq", F.col("kinds"), "in_force")
    return found.where("record = 'observation'").select(
        "stream", "seq", "obs_id", "facts", F.coalesce("in_force", start).alias("in_force")
    )


def undeclared_kind(feed: DataFrame, initial: list[str] | None = None) -> DataFrame:
    """Facts of a kind the capability in force does not hold."""
    facts = capability_in_force(feed, initial).select(
        "stream", "seq", "in_force", F.explode("facts").alias("fact")
    )
    kinds = facts.select("stream", "seq", "in_force", kind_of(F.col("fact")).alias("kind"))
    bad = kinds.where(~F.array_contains("in_force", F.col("kind")))
    return _violation(bad, "undeclared_kind", "kind").distinct()


def running_max_observed(feed: DataFrame) -> DataFrame:
    """Each record with the latest instant sighted at or before it."""
    slim = feed.select("stream", "seq", "record", "observed_at", "as_of")
    return running_max(slim, ["stream"], "seq", F.col("observed_at"), "latest_observed_at")


def capability_backdated(feed: DataFrame) -> DataFrame:
    """Capability records dated before a sighting that precedes them."""
    bad = running_max_observed(feed).where(
        "record = 'capability' and as_of < latest_observed_at"
    )
    return _violation(bad, "capability_backdated", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


def capability_order(feed: DataFrame) -> DataFrame:
    """Capability records dated before the one that precedes them."""
    caps = feed.where("record = 'capability'").select("stream", "seq", "as_of")
    prior = running_last(caps, ["stream"], "seq", F.col("as_of"), "_prior", before=True)
    return _violation(
        prior.where("as_of < _prior"),
        "capability_order",
        F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"),
    )


def cross_stream_obs(feed: DataFrame) -> DataFrame:
    """Ids found in two or more streams: (obs_id, first_stream, streams)."""
    return (
        feed.where("obs_id is not null")
        .select("obs_id", "stream")
        .distinct()
        .groupBy("obs_id")
        .agg(F.min("stream").alias("first_stream"), F.count("*").alias("streams"))
        .where("streams > 1")
    )


def _facts(feed: DataFrame) -> DataFrame:
    return feed.where("facts is not null").select("stream", "seq", F.explode("facts").alias("fact"))


def mac_flag(feed: DataFrame) -> DataFrame:
    """Macs whose stored local bit contradicts their bytes."""
    own = _facts(feed).where("fact.Mac is not null").select(
        "stream", "seq", F.col("fact.Mac.addr").alias("mac"),
        F.col("fact.Mac.locally_administered").alias("flag"),
    )
    return _violation(
        own.where(F.col("flag") != is_locally_administered(F.col("mac"))), "mac_flag", "mac"
    )


def address_rules(feed: DataFrame) -> DataFrame:
    """Facts naming an address or a host outside the allowed ranges."""
    f = F.col("fact")
    ip = F.coalesce(f["IpV4"]["addr"], f["DhcpLease"]["ip"])
    mac = F.coalesce(f["Mac"]["addr"], f["Uplink"]["peer_mac"])
    name = f["Hostname"]["name"]
    found = _facts(feed).select(
        "stream",
        "seq",
        F.when(ip.isNotNull() & ~A.is_documentation_ip(ip), "address_ip")
        .when(mac.isNotNull() & ~A.is_synthetic_mac(mac), "address_mac")
        .when(name.isNotNull() & ~A.is_invented_hostname(name), "address_hostname")
        .alias("rule"),
        F.coalesce(ip, mac, name).alias("detail"),
    )
    return found.where("rule is not null")


# A mac or an ipv4 that starts a run of hex digits, dots and colons.
_IN_TEXT = rf"(?<![0-9a-fA-F])((?:[0-9a-fA-F]{{2}}:){{5}}[0-9a-fA-F]{{2}}|{A.OCTET}(?:\.{A.OCTET}){{3}})"


def text_addresses(texts: DataFrame) -> DataFrame:
    """Addresses spelled in free text, with whether each is allowed.  ``texts`` is (id, text).

    Dashes count as colons, so both mac spellings are found.
    """
    spelled = texts.select(
        "id", F.explode(F.regexp_extract_all(F.replace("text", F.lit("-"), F.lit(":")), F.lit(_IN_TEXT), F.lit(1))).alias("spelling")
    )
    is_mac = F.col("spelling").contains(":")
    value = F.lower("spelling")
    return spelled.select(
        "id",
        F.when(is_mac, "mac").otherwise("ipv4").alias("kind"),
        value.alias("address"),
        F.when(is_mac, A.is_synthetic_mac(value))
        .otherwise(A.is_documentation_ip(value))
        .alias("allowed"),
    )


# ---------------------------------------------------------------- labels


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def _unclean(text: Column) -> Column:
    return (text != strip(text)) | text.rlike(r"\p{Cc}")


def folded(text: Column) -> Column:
    return F.lower(strip(text))


def label_rules(labels: DataFrame) -> DataFrame:
    """(case_id, rule) for every rule a label breaks; duplicates are judged case-folded."""
    c = F.col
    reason, rule, family = strip(c("reason")), c("expected_rule"), c("family")
    decides = c("expectation") != S.MUST_ABSTAIN
    count = F.length(reason)
    held = F.size("observations")
    checks = {
        "id_missing": _blank(c("case_id")),
        "reason_missing": _blank(c("reason")),
        "reason_not_one_line": reason.rlike(r"\p{Cc}"),
        "reason_too_short": (count > 0) & (count < 20),
        "reason_too_long": count > 300,
        "rule_missing": decides & _blank(rule),
        "rule_malformed": decides & ~_blank(rule) & _unclean(rule),
        "replay_missing": _blank(c("replay")),
        "observations_missing": F.coalesce(held < 1, F.lit(True)),
        "observation_repeated": F.size(F.array_distinct("observations")) != held,
        "family_empty": family.isNotNull() & _blank(family),
        "family_malformed": family.isNotNull() & ~_blank(family) & _unclean(family),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(r)) for r, test in checks.items()]))
    own = labels.select("case_id", F.explode(broken).alias("rule"))
    again = (
        labels.groupBy(folded(c("case_id")).alias("_folded"))
        .agg(F.count("*").alias("_n"), F.min("case_id").alias("case_id"))
        .where("_n > 1")
        .select("case_id", F.lit("id_duplicate").alias("rule"))
    )
    return own.unionByName(again)


def dangling_labels(labels: DataFrame, obs: DataFrame) -> DataFrame:
    """Labels naming a sighting their stream does not hold: (case_id, obs_id)."""
    named = labels.select(
        "case_id", F.col("replay").alias("stream"), F.explode("observations").alias("obs_id")
    )
    known = obs.select(F.col("connector_id").alias("stream"), "obs_id")
    return named.join(known, ["obs_id", "stream"], "left_anti").select("case_id", "obs_id")


# ---------------------------------------------------------------- stored tables


def _broken(df: DataFrame, row_id: str, checks: dict[str, Column]) -> DataFrame:
    rules = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in checks.items()])
    )
    return df.select(_text(row_id).alias("row_id"), F.explode(rules).alias("rule"))


def link_constraints(links: DataFrame, obs: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(row_id, rule) for every invariant a link row breaks."""
    c = F.col
    out = c("outcome") == S.ABSTAINED
    open_row = c("valid_to") == open_end()
    own = _broken(
        links,
        "link_id",
        {
            "outcome": c("outcome").isin(S.MATCH, S.NO_MATCH, S.ABSTAINED),
            "decided_by": c("decided_by").isin(S.ENGINE, S.OPERATOR),
            "rule_xor_cause": F.when(
                out, c("rule_id").isNull() & c("abstention_cause").isNotNull()
            ).otherwise(c("rule_id").isNotNull() & c("abstention_cause").isNull()),
            "rule_not_empty": c("rule_id").isNull() | (c("rule_id") != ""),
            "abstained_has_no_interface": out == c("interface_id").isNull(),
            "current_subject": F.when(
                open_row,
                c("current_subject").eqNullSafe(F.coalesce("interface_id", F.lit(S.NIL_ID))),
            ).otherwise(c("current_subject").isNull()),
            "interval": F.when(open_row, c("valid_from") < c("valid_to")).otherwise(
                c("valid_from") <= c("valid_to")
            ),
        },
    )
    held = links.where("current_subject is not null")
    slots = (
        held.groupBy("observation_id", "current_subject")
        .agg(F.count("*").alias("_n"), F.min("link_id").alias("link_id"))
        .where("_n > 1")
        .select(_text("link_id").alias("row_id"), F.lit("one_current").alias("rule"))
    )
    no_obs = links.join(
        obs.select(c("obs_id").alias("observation_id")), "observation_id", "left_anti"
    ).select(_text("link_id").alias("row_id"), F.lit("observation_fk").alias("rule"))
    no_interface = (
        links.where("interface_id is not null")
        .join(interfaces.select("interface_id"), "interface_id", "left_anti")
        .select(_text("link_id").alias("row_id"), F.lit("interface_fk").alias("rule"))
    )
    return own.unionByName(slots).unionByName(no_obs).unionByName(no_interface)


def interface_constraints(interfaces: DataFrame, row_id: str = "interface_id") -> DataFrame:
    c = F.col
    return _broken(
        interfaces,
        row_id,
        {
            "id_not_nil": c("interface_id") != S.NIL_ID,
            "window": c("first_seen_at") <= c("last_seen_at"),
            "mac_lower": c("mac") == F.lower("mac"),
        },
    )


def declared_constraints(declared: DataFrame) -> DataFrame:
    """Row rules, one value per (entity, key), one adoption per (sighting, key)."""
    c = F.col
    row_id = F.concat_ws(":", _text("entity_id"), c("attr_key"))
    rows = declared.withColumn("_row", row_id)
    own = _broken(
        rows,
        "_row",
        {
            "adopted_has_obs": (c("origin") != "adopted") | c("origin_obs_id").isNotNull(),
            "actor_not_scanner": c("actor_id") != "scanner",
        },
    )
    twice = (
        rows.groupBy("_row")
        .agg(F.count("*").alias("_n"))
        .where("_n > 1")
        .select(c("_row").alias("row_id"), F.lit("one_value_per_key").alias("rule"))
    )
    adopted = (
        rows.where("origin_obs_id is not null")
        .groupBy("origin_obs_id", "attr_key")
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_row"))
        .where("_n > 1")
        .select(c("_row").alias("row_id"), F.lit("one_adoption_per_field").alias("rule"))
    )
    return own.unionByName(twice).unionByName(adopted)
