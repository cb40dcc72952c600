"""I-Match fingerprints: terms of a band of inverse document frequency, several randomised lexicons.

The lexicon holds the terms whose share of documents lies between ``RARE`` and ``COMMON``.  Its
randomised subsets are classes of the terms' hashes: subset (level, seed) keeps the terms whose low
``level`` bits are those of the seed, about one in 2^level.  A document uses the ``LEVELS`` levels
that leave a few of its terms in a subset; per subset its distinct terms, sorted, are hashed together,
and the fingerprint is the sorted list of these hashes.  One edit changes the subsets that hold the
edited terms and leaves the others.

Everything is DataFrame functions.  Only terms of a used subset are looked up, some 50 for a document
of any length.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import settle, words

RARE = 0.001  # with so many distinct terms a document, the lexicon has at most 1 / RARE times as many
COMMON = 0.3
SEEDS = 16
LEVELS = 4
LEXICON_ROWS = 1_000_000  # broadcast up to so many terms, of 8 bytes each
ROWS_PER_RANGE = 4_000
MOST_RANGES = 1 << 16
# Seed j ends with the bits of j, so that sixteen classes part the terms from level 4 on.
SEED_BITS = [j + 16 * ((j + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 20) for j in range(SEEDS)]


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(term): hashes of the terms that at least ``rare`` and at most ``common`` of all documents hold."""
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    return settle(counts.where(F.col("n").between(total * rare, total * common)).select("term"), "lexicon")


def _level(n_terms: Column) -> Column:
    """The densest level used: a subset of it keeps two to four of so many terms."""
    return F.greatest(F.length(F.bin(n_terms)) - 2, F.lit(0))


def _mask(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1


def _seeds() -> Column:
    return F.array(*[F.lit(s).cast("bigint") for s in SEED_BITS])


def asked(found: Column) -> Column:
    """The terms that fall into some used subset, sorted."""

    def of(t: Column) -> Column:
        mask = _mask(_level(F.size(t)))
        own = lambda x: _seeds()[x.bitwiseAND(SEEDS - 1).cast("int")]
        # Up to level 4 every term is in the class of its last bits.
        return F.filter(t, lambda x: x.bitwiseXOR(own(x)).bitwiseAND(mask) == 0)

    return F.sort_array(F.transform(F.array(found), of)[0])


def prints(kept: Column, n_terms: Column, whole: Column) -> Column:
    """Sorted hashes of the non-empty subsets of ``kept``; that of all terms where there is none."""
    level = _level(n_terms)

    def of_seed(j: Column) -> Column:
        seed = _seeds()[j]
        # The subsets of a seed are nested: the denser levels are looked through for the sparser ones.
        dense = F.filter(kept, lambda x: x.bitwiseXOR(seed).bitwiseAND(_mask(level)) == 0)
        return F.transform(F.array(dense), lambda d: F.transform(
            F.sequence(level, level + LEVELS - 1), lambda at: hashed(d, at, seed)
        ))[0]

    def hashed(dense: Column, at: Column, seed: Column) -> Column:
        inside = F.filter(dense, lambda x: x.bitwiseXOR(seed).bitwiseAND(_mask(at)) == 0)
        return F.transform(F.array(inside), lambda s: F.when(
            F.size(s) > 0, F.xxhash64(at, seed.bitwiseAND(_mask(at)), s)
        ))[0]

    made = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), of_seed))
    made = F.transform(F.array(F.array_compact(made)), lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(whole)))[0]
    short = F.transform(made, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(0xFFFFFFFF)), 8, "0")))
    return F.sort_array(F.array_distinct(short))


def _told_by(which: int):
    return lambda x: F.struct(F.lit(which).alias("which"), x.alias("term"))


def fingerprints(rows: DataFrame, lex: DataFrame, by: list[str], texts: dict[str, str]) -> DataFrame:
    """(the columns of ``rows`` but the texts, an array of hashes per text named in ``texts``).

    ``by`` tells rows apart, without nulls; where ``rows`` are dealt by some of these columns nothing is
    shuffled.  ``texts`` gives each text column its result's name.  A null text counts as an empty one;
    texts of equal words have equal fingerprints, those without a term of the lexicon that of all their
    terms; an empty table gives none.
    """
    known = lex.select(F.col("term"), F.lit(True).alias("_known"))
    if lex.count() <= LEXICON_ROWS:
        known = F.broadcast(known)
    rest = [c for c in rows.columns if c not in (*by, *texts)]
    found = rows.select(*by, F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), *[
        terms(F.coalesce(F.col(c), F.lit(""))).alias(f"_t{i}") for i, c in enumerate(texts)
    ])
    told = F.array(*[
        F.struct(F.size(f"_t{i}").alias("n"), F.xxhash64(F.sort_array(f"_t{i}")).alias("whole"))
        for i in range(len(texts))
    ])
    each = F.concat(F.array(F.struct(F.lit(-1).alias("which"), F.lit(None).cast("bigint").alias("term"))), *[
        F.transform(asked(F.col(f"_t{i}")), _told_by(i)) for i in range(len(texts))
    ])
    one = found.select(*by, F.struct("_rest", told.alias("told")).alias("_row"), F.explode(each).alias("_e"))
    # Only the first line of a row carries its other columns.
    one = one.select(*by, F.when(F.col("_e.which") < 0, F.col("_row")).alias("_row"), "_e.*")
    met = one.join(known, "term", "left")
    lists = [
        F.sort_array(F.collect_list(F.when((F.col("which") == i) & F.col("_known"), F.col("term")))).alias(f"_k{i}")
        for i in range(len(texts))
    ]
    met = met.groupBy(*by).agg(F.first("_row", ignorenulls=True).alias("_row"), *lists)
    return met.select(*by, *[F.col(f"_row._rest.`{c}`").alias(c) for c in rest], *[
        prints(F.col(f"_k{i}"), F.col("_row.told")[i]["n"], F.col("_row.told")[i]["whole"]).alias(name)
        for i, name in enumerate(texts.values())
    ])


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets' hashes that two fingerprints have in common, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most the key, less one: a binary search."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    literal = F.array(*[F.lit(c).cast("bigint") for c in cuts])

    def step(at: Column, by: Column) -> Column:
        last = F.least(at + by, F.lit(len(cuts))) - 1
        return F.when((at + by <= len(cuts)) & (literal[last] <= key), at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) - 1


def in_order(docs: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(the columns of ``docs``, _range, _at, next_text): each row beside the text after it.

    Rows ascend by ``doc_id``, null ones first, ties by the hash of the text; after the last comes the
    first.  Ranges of about ``per_range`` rows are cut at counted quantiles; the first row of a range
    is lent to the range before it, so every row finds its successor in its own range.
    """
    total, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    tie = F.xxhash64("text")
    key = F.col("doc_id").cast("bigint")
    if ids < total:  # rows without an id are spread below all ids by their text
        key = F.coalesce(key, F.lit(-(1 << 62)) - F.shiftright(tie, 3).bitwiseAND((1 << 60) - 1))
    keys = docs.select(key.alias("key"))
    n = min(MOST_RANGES, max(1, total // per_range))
    shares = [i / n for i in range(1, n)]
    near = sorted(set(keys.agg(F.percentile_approx("key", shares, 20 * n)).first()[0] or [])) if shares and total else []
    first = keys.groupBy(_range_of(F.col("key"), near).alias("r") if near else F.lit(0).alias("r")).agg(F.min("key"))
    cuts = sorted(r[1] for r in first.collect()) or [0]  # one row per range
    lent = dict(zip(cuts, [len(cuts) - 1, *range(len(cuts) - 1)], strict=True))
    mine = docs.select(F.struct("*").alias("row"), key.alias("_key"), tie.alias("_tie"))
    mine = mine.withColumn("_own", _range_of(F.col("_key"), cuts))
    places = F.array(F.lit(len(cuts) - 1), *[F.lit(i) for i in range(len(cuts) - 1)])
    opens = F.array(*[F.lit(c).cast("bigint") for c in lent])
    lends = opens[F.col("_own")] == F.col("_key")
    place = lambda r, guest: F.struct(r.cast("int").alias("_range"), F.lit(guest).alias("_guest"))
    own = place(F.col("_own"), 0)
    dealt = mine.select("row", "_key", "_tie", F.explode(
        F.when(lends, F.array(own, place(places[F.col("_own")], 1))).otherwise(F.array(own))
    ).alias("_p")).select("row", "_key", "_tie", "_p.*")
    order = Window.partitionBy("_range").orderBy("_guest", "_key", "_tie")
    return dealt.select(
        "row.*", "_range", "_guest", F.row_number().over(order).alias("_at"),
        F.lead(F.col("row.text")).over(order).alias("next_text"),
    )


def with_edits(docs: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, text, _range, _guest, _at, n_chars, edited, edited_sha256) of every document.

    In the edited text the first characters of the next document stand in place of the last quarter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = in_order(docs.select("doc_id", text.alias("text")), per_range)
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - k), F.left(F.coalesce("next_text", F.lit("")), k))
    found = found.select("doc_id", "text", "_range", "_guest", "_at", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256))


def compared(docs: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Fingerprints of all documents and of their edited texts, with their likeness to each other and to
    the next document's.  One row a row: repeated rows count each, a null text as an empty one.
    """
    lex = lexicon(docs)
    made = fingerprints(
        with_edits(docs, per_range), lex, ["_range", "_at"], {"text": "prints", "edited": "edited_prints"}
    )
    made = made.withColumn("next_prints", F.lead("prints").over(Window.partitionBy("_range").orderBy("_at")))
    return made.where("_guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("prints", "").alias("fingerprint"),
        F.array_join("edited_prints", "").alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
