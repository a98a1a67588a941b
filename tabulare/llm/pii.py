"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds: e-mail addresses, IP addresses, card numbers and phone numbers found
by their written form (with the checks of each kind). The words left of the
seeds become lexical patterns. Over the bipartite graph of patterns and the
identifier-like strings they precede (strings with a digit or ``@``), pattern
and instance scores are computed in turn: a pattern's score is the mean
confidence of the distinct instances it precedes, of whatever kind, and its
kind the one with the largest share of that; an instance's score is the
noisy-or of its reliable patterns, its kind that of the best. Scores only
rise, and the turns end when neither a pattern nor an instance is new.
Reliable patterns then mark unseen identifiers; seeds always stay.

Scale: the text is scanned where it is read and never shuffled; only the
occurrences (tens of bytes each, in the few documents that have any) enter
the graph's grouped sums and joins, both free of per-key tasks. Positions
come from the lengths of the pieces between matches by parallel prefix sums
within the row, ``k log k`` for k matches. All patterns match in linear time:
possessive repetition, and a match starts only at the start of its run.

Defined results for odd input: NULL text is empty and has no spans; repeated
rows (same id and text) get equal results; a NULL id keeps its own row; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_HOST = "A-Za-z0-9-"
# Written forms; equivalent to the plain greedy ones, but never rescanning a run.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Identifier-like strings: adjacent tokens with a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
CONTEXT = 80               # characters left of an occurrence that hold its context, as a rule; else all of them are searched
NAMED = 256                # characters above which a context goes by its SHA-256
MIN_SUPPORT = 5            # distinct confident instances a reliable pattern precedes
RELIABLE = 0.8             # least score of a reliable pattern or instance
_SPANS = "array<struct<kind:int,start:bigint,end:bigint,hit:string,left:string>>"


def prefix(values: Column, op) -> Column:
    """Inclusive scan of an array by an associative ``op``, in log2(size) array passes."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")),
                        lambda j: F.pow(F.lit(2), j).cast("int"))
    return F.aggregate(steps, values, lambda a, s: F.transform(
        a, lambda v, i: F.when(i >= s, op(v, F.get(a, i - s))).otherwise(v)))


def _last_words(gap: Column) -> Column:
    """The end of ``gap`` that holds its last two words whole."""
    end = F.right(gap, F.lit(CONTEXT))
    return F.when((F.length(gap) <= CONTEXT) | end.rlike(r"\s\S++\s++\S++\s*+\z"), end).otherwise(
        F.regexp_extract(gap, r"(?<!\S)(?:\S++\s++)?+\S++\s*+\z", 0))


def _find(df: DataFrame, pattern: str, guard: Column, out: str, text: str = "text") -> DataFrame:
    """Add ``out``: an array of ``(start, end, hit, left)`` for all matches, and ``out_gaps`` between them."""
    df = df.withColumn("_hits", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")))          # NULL: none, nothing below runs
    df = df.withColumn(f"{out}_gaps", F.when(F.col("_hits").isNotNull(), F.split(F.col(text), pattern, -1)))
    gaps = F.col(f"{out}_gaps")
    df = df.withColumn("_starts", prefix(F.transform("_hits", lambda h, i: (
        F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(F.col("_hits"), i - 1))).otherwise(0)).cast("long")),
        lambda a, b: a + b))
    df = df.withColumn(out, F.transform("_hits", lambda h, i: F.struct(
        F.get(F.col("_starts"), i).alias("start"), (F.get(F.col("_starts"), i) + F.length(h)).alias("end"),
        h.alias("hit"), F.lower(_last_words(F.get(gaps, i))).alias("left"))))
    return df.drop("_hits", "_starts")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + (
        lambda d: F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))(F.substr(back, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    d = _digits(hit)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(8, 15)


def _guard(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def located(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, base, unseen``: seeds by kind and start, and identifier-like strings clear of them.

    ``mark`` with ``doc_id`` names the row's text; repeated rows share it.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for n, kind in enumerate(KINDS):
        df = _find(df, PATTERNS[kind], _guard(kind, F.col("text")), kind).drop(f"{kind}_gaps")
        df = df.withColumn(kind, F.transform(F.filter(kind, lambda s: _valid(kind, s["hit"])), lambda s: F.struct(
            F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["left"].alias("left"))))
    df = df.withColumn("base", F.concat(*[F.coalesce(k, F.array().cast(_SPANS)) for k in KINDS]))
    df = _find(df, CANDIDATE, F.col("text").rlike("[0-9@]"), "found").drop("found_gaps")
    # without punctuation around it
    trimmed = F.transform("found", lambda s: (lambda lead: (lambda hit: F.struct(
        F.lit(len(KINDS)).alias("kind"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(hit)).alias("end"),
        hit.alias("hit"), s["left"].alias("left")))(F.regexp_replace(F.regexp_replace(s["hit"], r"^[^\p{L}\p{N}+]++", ""), r"[^\p{L}\p{N}]++$", "")))(
        F.length(s["hit"]) - F.length(F.regexp_replace(s["hit"], r"^[^\p{L}\p{N}+]++", ""))))
    df = df.withColumn("unseen", F.filter(trimmed, lambda s: s["end"] > s["start"]))
    # clear of seeds: no seed that starts before reaches in, no seed starts inside
    df = df.withColumn("_all", F.when(F.size("unseen") > 0, F.array_sort(F.transform(
        F.concat("base", "unseen"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
                                                       s["hit"].alias("hit"), s["left"].alias("left"))))))
    seed = lambda s: s["kind"] < len(KINDS)
    df = df.withColumn("_reach", prefix(F.transform("_all", lambda s: F.when(seed(s), s["end"]).otherwise(F.lit(-1).cast("long"))),
                                        lambda a, b: F.greatest(a, b)))
    far = F.lit(1 << 62).cast("long")
    df = df.withColumn("_next", F.reverse(prefix(F.reverse(F.transform("_all", lambda s: F.when(seed(s), s["start"]).otherwise(far))),
                                                 lambda a, b: F.least(a, b))))
    df = df.withColumn("unseen", F.filter("_all", lambda s, i: ~seed(s) & (F.get(F.col("_reach"), i) <= s["start"])
                                          & (F.get(F.col("_next"), i) >= s["end"])))
    return df.select("doc_id", F.xxhash64("text").alias("mark"), "base", "unseen")


def _contexts(left: Column) -> Column:
    """Lexical patterns of an occurrence: its last word, and its last two, before it."""
    two = F.regexp_extract(left, r"(\S++\s++\S++)\s*+$", 1)
    one = F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1)
    short = lambda c: F.when(F.length(c) > NAMED, F.sha2(c, 256)).otherwise(c)
    return F.filter(F.array(short(F.regexp_replace(two, r"\s++", " ")), short(one)), lambda c: c != "")


def reliable_patterns(occurrences: DataFrame) -> DataFrame:
    """``(context, kind, score)`` of the reliable patterns among ``(context, hit, kind)`` occurrences (kind NULL: unseen)."""
    graph = materialize(occurrences.groupBy("context", "hit").agg(F.max("kind").alias("seed")), "pii-graph")
    degree = materialize(graph.groupBy("context").agg(F.count(F.lit(1)).alias("degree")), "pii-degree")
    # a pattern that precedes fewer instances than the support can never become reliable
    graph = materialize(graph.join(degree.where(F.col("degree") >= MIN_SUPPORT), "context"), "pii-graph")
    seeds = materialize(graph.where("seed IS NOT NULL").groupBy("hit").agg(F.max("seed").alias("kind")).select(
        "hit", "kind", F.lit(1.0).alias("trust")), "pii-seeds")
    believed, before = seeds, None
    while True:
        by_kind = graph.join(believed, "hit").groupBy("context", "kind").agg(
            F.sum("trust").alias("trust"), F.count(F.lit(1)).alias("support"), F.max("degree").alias("degree"))
        scored = by_kind.groupBy("context").agg(
            (F.sum("trust") / F.max("degree")).alias("score"), F.sum("support").alias("support"),
            F.max(F.struct("trust", (-F.col("kind")).alias("back"))).alias("lead"))
        patterns = materialize(scored.where((F.col("support") >= MIN_SUPPORT) & (F.col("score") >= RELIABLE))
                               .select("context", (-F.col("lead.back")).alias("kind"), "score"), "pii-patterns")
        grown = (graph.where("seed IS NULL").join(patterns, "context").groupBy("hit")
                      .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("trust"),
                           F.max(F.struct("score", (-F.col("kind")).alias("back"))).alias("lead")))
        grown = materialize(grown.where(F.col("trust") >= RELIABLE).select("hit", (-F.col("lead.back")).alias("kind"), "trust"), "pii-grown")
        reached = (patterns.count(), grown.count())
        if reached == before or not reached[1]:
            return patterns
        before, believed = reached, seeds.unionByName(grown.join(seeds, "hit", "left_anti"))


def discovered(found: DataFrame) -> DataFrame:
    """``doc_id, mark, extra``: spans ``(kind, start, end)`` of unseen identifiers that reliable patterns mark."""
    one = lambda column, kind: found.select("doc_id", "mark", F.inline(column)).select(
        "doc_id", "mark", kind.cast("int").alias("kind"), "start", "end", "hit", F.explode(_contexts(F.col("left"))).alias("context"))
    seen = one("base", F.col("kind"))
    unseen = materialize(one("unseen", F.lit(None)), "pii-unseen")
    patterns = reliable_patterns(seen.unionByName(unseen).select("context", F.lower("hit").alias("hit"), "kind"))
    best = (unseen.drop("kind").join(patterns, "context").groupBy("doc_id", "mark", "start", "end")
                  .agg(F.max(F.struct("score", -F.col("kind"))).alias("best")))
    return best.select("doc_id", "mark", (-F.col("best.col2")).alias("kind"), "start", "end").groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, mark, base, extra``: spans ``(kind, start, end)`` in code points, by kind and start."""
    found = materialize(located(docs), "pii-located")
    extra = materialize(discovered(found), "pii-extra")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    x = extra.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "extra")
    return (found.join(x, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
                 .select("doc_id", "mark", bare(F.col("base")).alias("base"),
                         F.coalesce("extra", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("extra")))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts by kind, the digest of the base spans, and all spans."""
    found = detect(docs)
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def merged(spans: Column) -> Column:
    """Union of spans ``(start, end, kind)`` sorted by start: overlapping ones become one, of the first one's kind."""
    reach = prefix(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    heads = lambda r: F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(r, i - 1) <= s["start"]), i)), lambda i: i.isNotNull())
    # the reach and the heads are computed once: each is the element of a one-element array
    whole = F.transform(F.array(reach), lambda r: F.transform(F.array(heads(r)), lambda h: F.transform(h, lambda at, j: F.struct(
        F.get(spans, at)["start"].alias("start"), F.get(r, F.coalesce(F.get(h, j + 1), F.size(spans)) - 1).alias("end"),
        F.get(spans, at)["kind"].alias("kind")))))
    return F.get(F.get(whole, F.lit(0)), F.lit(0))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars`` follows the text.

    Spans are those of the original text. Where some overlap or patterns have
    added any, their union is masked first, at its places; what is left (spans
    that touch no other, and what only masking makes a match) goes kind by kind.
    """
    found = materialize(located(docs), "pii-located")
    extra = materialize(discovered(found), "pii-extra").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "extra")
    spans = found.where(F.size("base") > 0).join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "full").select(
        F.coalesce("doc_id", "_d").alias("_d"), F.coalesce("mark", "_m").alias("_m"), F.col("extra").isNotNull().alias("more"),
        F.array_sort(F.concat(*[F.transform(F.coalesce(c, F.array().cast(kind)), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
            for c, kind in (("base", _SPANS), ("extra", "array<struct<kind:int,start:bigint,end:bigint>>"))])).alias("all"))
    spans = spans.withColumn("_spans", merged(F.col("all"))).where(F.col("more") | (F.size("_spans") < F.size("all")))
    extra = materialize(spans.groupBy("_d", "_m").agg(F.any_value("_spans").alias("_spans")), "pii-spans")
    # the row travels as one struct, so its column names cannot clash with ours
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"))
    df = df.join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")), "left")
    name = lambda k: F.get(F.array(*[F.lit(f"<{x.upper()}>") for x in KINDS]), k)
    before = lambda i: F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0))
    df = df.withColumn("_text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join(F.transform("_spans", lambda s, i: F.concat(
            F.substr(F.col("text"), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), name(s["kind"]))), ""),
        F.substr(F.col("text"), (F.element_at(F.col("_spans"), -1)["end"] + 1).cast("int")))))
    for n, kind in enumerate(KINDS):
        df = _find(df, PATTERNS[kind], _guard(kind, F.col("_text")), "_f", "_text")
        df = df.withColumn("_text", F.when(F.col("_f").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(
            "_f_gaps", lambda g, i: F.concat(g, F.when(i < F.size("_f"), F.when(
                _valid(kind, F.get(F.col("_f"), i)["hit"]), F.lit(f"<{kind.upper()}>")).otherwise(F.get(F.col("_f"), i)["hit"])).otherwise(""))), "")))
    out = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_text") == F.col("text"), F.col("row.n_chars")).otherwise(F.length("_text")).cast(
            docs.schema["n_chars"].dataType)
    return df.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
