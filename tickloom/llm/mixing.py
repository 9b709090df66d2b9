"""Mixing sources to target weights by hierarchical token budgets, in DataFrame operations only.

The tree is domain, language, source. Each level shares its parent's budget among siblings by their weights; a node whose
documents cannot fill its share (in ``max_epochs`` passes) takes what it has, and the shortage goes to its siblings. Only
a parent whose children are all exhausted passes a shortage on, to its own siblings. A leaf then takes whole epochs and,
of the next one, the longest token-prefix that fits; each epoch has an order of its own from the seed.

A leaf may hold any share of the rows: its prefix sums are taken within slices of about ``slice_rows`` documents by the
leading digits of the order's hash, after a small table of slice totals, so no task holds a whole leaf. Rows equal in id and
text are counted first and take part as one row with a number.

Nulls and edge cases: a null text has no words; a null language or source is the name ``''``; names without a weight get
``other``; rows that repeat an id are documents of their own, taken one after the other; a leaf without words takes
its documents whenever their place in the order is reached; an empty table gives an empty result; other columns are kept by ``mixed`` and ignored by ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tickloom.llm.common import cut

LEVELS = ["domain", "lang", "source"]
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Target weights: of each domain, of each language within a domain; sources within a language weigh alike."""

    fraction: float = 0.6
    max_epochs: int = 2
    seed: int = 5
    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "reference": 0.3, "community": 0.2})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1})
    other: float = 0.05
    slice_rows: int = 2000


def domain_of_source() -> Column:
    """The domain by the number in a source's name; ``other`` where it has none."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,9})$", 1)
    third = F.when(number != "", number.cast("int") % 3)
    return F.when(third == 0, "web").when(third == 1, "reference").when(third == 2, "community").otherwise("other")


def _weight(name: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(None).cast("double")
    for key, w in weights.items():
        out = F.when(F.col(name) == key, F.lit(float(w))).otherwise(out)
    return F.coalesce(out, F.lit(float(other)))


def shared(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` with ``give``: each sibling's part of ``budget`` by ``weight``, at most its ``room``; the rest to the others.

    Siblings are filled in the order of room by weight, so those that run short come first and what is left is shared by
    the weights that are left.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = by.orderBy(F.col("room") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))) / (F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = nodes.withColumn("level", level).withColumn("short", F.col("room") <= F.col("weight") * F.col("level"))
    return ranked.withColumn("even", F.max(F.when(~F.col("short"), F.col("level"))).over(by)).withColumn("give", F.when(F.col("short"), F.col("room").cast("double")).otherwise(F.col("weight") * F.col("even"))).drop("level", "short", "even")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, docs of the leaves with their ``budget`` in whole tokens."""
    room = F.col("tokens") * mix.max_epochs
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    domains = leaves.groupBy("domain").agg(F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("room", room).withColumn("budget", F.floor(total * F.lit(mix.fraction))).withColumn("weight", _weight("domain", mix.domains, mix.other))
    given = shared(domains, [], "domain").select("domain", F.col("give").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"))
    langs = langs.withColumn("room", room).join(given, "domain").withColumn("weight", _weight("lang", mix.languages, mix.other))
    given = shared(langs, ["domain"], "lang").select("domain", "lang", F.col("give").alias("budget"))
    sources = leaves.withColumn("room", room).join(given, ["domain", "lang"]).withColumn("weight", F.lit(1.0))
    given = shared(sources, ["domain", "lang"], "source")
    return given.select(*LEVELS, "tokens", "docs", F.floor(F.col("give") + 1e-6).cast("long").alias("budget"))


#: Names that ``select`` uses itself.
RESERVED = frozenset(("doc_id", "domain", "lang", "source", "n_tokens", "copies", "digest", "tokens", "docs", "budget", "whole", "rest", "order", "slice", "times", "before", "inside", "fits", "k"))


def select(docs: DataFrame, mix: Mix, domain: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The chosen documents: doc_id, domain, lang, source, n_tokens and copies, the number of epochs that hold them.

    keep: further columns of ``docs`` to carry along, of types that can be ordered; they tell rows apart. The names of ``RESERVED``
    are refused.
    """
    keep = keep or []
    if clash := RESERVED & set(keep):
        raise ValueError(f"columns of these names can't be kept: {', '.join(sorted(clash))}")
    counted = docs.select(
        "doc_id",
        (domain_of_source() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("n_tokens"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        *keep,
    )
    counted = cut(counted, "counted")
    leaves = cut(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    whole = F.coalesce(F.floor(F.col("budget") / F.when(F.col("tokens") > 0, F.col("tokens"))), F.lit(0))
    plan = cut(budgets(leaves, mix).withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "plan")
    dealt = counted.join(plan, LEVELS).withColumn("order", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")))
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    dealt = dealt.withColumn("slice", F.floor(share * F.ceil(F.col("docs") / mix.slice_rows)))
    dealt = dealt.groupBy(*LEVELS, "slice", "order", "doc_id", "n_tokens", "whole", "rest", *keep).agg(F.count("*").alias("times"))
    size = F.sum(F.col("n_tokens") * F.col("times"))
    slices = dealt.groupBy(*LEVELS, "slice").agg(size.alias("size"))
    before = slices.withColumn("before", F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("slice")) - F.col("size")).drop("size")
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("order", "doc_id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("inside", size.over(inside)).join(before, [*LEVELS, "slice"])
    # Of equal rows, so many as still fit are taken once more.
    room = F.col("rest") - F.col("before") - F.col("inside") + F.col("n_tokens") * F.col("times")
    fits = F.when(room < 0, 0).when(F.col("n_tokens") == 0, F.col("times")).otherwise(F.least("times", F.floor(room / F.col("n_tokens"))))
    each = placed.withColumn("fits", fits).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    copies = F.col("whole") + F.when(F.col("k") <= F.col("fits"), 1).otherwise(0)
    return each.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies", *keep)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once for every epoch that holds it."""
    # The rows' own columns travel in a struct, where no name of theirs can meet one of these. Rows that differ anywhere differ in h. A hash
    # passes over nulls, so h is taken of where these are too: of nested columns, by their JSON with nulls written out.
    fields = [(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    own = [c for c, kind in fields if "map<" not in kind.simpleString()]
    nested = [c for c, kind in fields if isinstance(kind, (ArrayType, MapType, StructType))]
    as_json = [F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}) for c in nested]
    h = F.xxhash64(*own, *(c.isNull() for c, _ in fields), *as_json)
    keyed = docs.select("doc_id", "lang", "source", "text", h.alias("h"), F.struct("*").alias("row"))
    chosen = select(keyed, mix, keep=["h"]).groupBy("doc_id", "h").agg(F.sum("copies").cast("int").alias("copies"))
    left, right = keyed.select("doc_id", "h", "row").dropDuplicates(["doc_id", "h"]).alias("d"), chosen.alias("c")
    joined = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.h") == F.col("c.h")))
    return joined.select("d.row", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("epoch")).select("row.*")


def sql(mix: Mix) -> str:
    """DuckDB SQL for the rows of ``select`` with ``domain_of_source``."""

    def weights(name: str, of: dict[str, float]) -> str:
        return f"CASE {' '.join(f"WHEN {name} = '{k}' THEN {float(w)}::DOUBLE" for k, w in of.items())} ELSE {float(mix.other)}::DOUBLE END"

    def level(source: str, parents: str, name: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        before = f"OVER ({by} ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""SELECT *, CASE WHEN short THEN room::DOUBLE ELSE weight * max(CASE WHEN NOT short THEN level END) OVER ({by}) END AS give FROM (
            SELECT *, room <= weight * level AS short FROM (
            SELECT *, (budget - coalesce(sum(room) {before}, 0)) / (sum(weight) OVER ({by}) - coalesce(sum(weight) {before}, 0)) AS level FROM ({source})))"""

    room = f"tokens * {mix.max_epochs}"
    return f"""
WITH n AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,9}})$', 1), '') AS INTEGER) % 3 AS third, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS digest FROM documents),
d AS (SELECT doc_id, CASE third WHEN 0 THEN 'web' WHEN 1 THEN 'reference' WHEN 2 THEN 'community' ELSE 'other' END AS domain, lang, source, n_tokens, digest FROM n),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
l1 AS ({level(f"SELECT domain, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {mix.max_epochs} AS room, floor(sum(sum(tokens)) OVER () * {mix.fraction}::DOUBLE) AS budget, {weights('domain', mix.domains)} AS weight FROM leaves GROUP BY domain", "", "domain")}),
l2 AS ({level(f"SELECT s.domain, lang, s.room, l1.give AS budget, {weights('lang', mix.languages)} AS weight FROM (SELECT domain, lang, sum(tokens)::BIGINT * {mix.max_epochs} AS room FROM leaves GROUP BY ALL) s JOIN l1 USING (domain)", "domain", "lang")}),
l3 AS ({level(f"SELECT s.domain, s.lang, source, s.tokens, {room} AS room, l2.give AS budget, 1.0::DOUBLE AS weight FROM leaves s JOIN l2 USING (domain, lang)", "domain, lang", "source")}),
plan AS (SELECT domain, lang, source, floor(give + 1e-6)::BIGINT AS budget, tokens, coalesce(floor(floor(give + 1e-6) / nullif(tokens, 0)), 0)::BIGINT AS whole FROM l3),
o AS (SELECT d.*, whole, budget - whole * tokens AS rest, md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS k FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, copies FROM (SELECT *, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM c) WHERE copies > 0
"""
