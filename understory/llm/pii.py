"""Personal data by bootstrapped contextual extraction, in built-in expressions only.

Strict patterns find seed entities. The words before them form lexical patterns; Spark scores the graph of patterns and
instances for some rounds (patterns by how surely the share of their instances that is known to be of a kind is high,
instances by the patterns that find them), and what stands behind high-confidence patterns joins the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from understory.session import written

#: Kinds in the order of the results, each with the pattern of its candidates. Possessive and look-behind forms find the
#: same leftmost matches as the plain ones, in linear time and without deep recursion.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind's texts hold one of these characters at least.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
SPACE = r"\x20\x09-\x0D"
#: Words that may be unseen identifiers: six characters or more, with a digit or an at sign.
CANDIDATE = rf"(?<![^{SPACE}])(?=[^{SPACE}]*?[0-9@])[^{SPACE}]{{6,}}+"
ROUNDS = 3
#: A pattern counts if the lower bound (95 %) of its precision reaches HIGH; an instance if its score does.
HIGH = 0.7
SURE = 0.7
BEFORE = 80
SPAN = "array<struct<kind:int,start:long,end:long>>"


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    luhn = F.aggregate(turned, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0
    return F.when(F.length(digits).between(13, 19), luhn).otherwise(False)


def _spans(text: Column, pattern: str, code: int, valid) -> Column:
    """Spans (kind code, start, end in code points) of the valid matches: gaps and matches alternate along the text."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.element_at(gaps, i + 1)).alias("gap")))
    state = F.aggregate(
        steps, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["m"])).alias("at"),
            F.when(valid(s["m"]), F.concat(acc["spans"], F.array(F.struct(
                F.lit(code).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["m"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return state["spans"]


def base_spans(text: Column) -> Column:
    """All strict spans, by kind as listed, then by start."""
    none = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    parts = []
    for code, (kind, pattern) in enumerate(KINDS.items()):
        worth = text.contains(NEEDED[kind]) & (F.lit(True) if kind == "email" else digit) if NEEDED[kind] else digit
        parts.append(F.when(worth, _spans(text, pattern, code, lambda m, kind=kind: _valid(kind, m))).otherwise(none))
    return F.concat(*parts)


def _context(text: Column, start: Column) -> Column:
    """The lexical patterns of a place: the last word and the last two words before it, lower-cased; ``^`` at the start."""
    before = F.lower(F.substring(text, F.greatest(start - BEFORE + 1, F.lit(1)).cast("int"), F.least(start, F.lit(BEFORE)).cast("int")))
    words = F.filter(F.split(before, rf"[{SPACE}]+"), lambda w: w != "")
    n = F.size(words)
    return F.when(n == 0, F.array(F.lit("^"))).when(n == 1, F.array(F.element_at(words, -1))).otherwise(
        F.array(F.try_element_at(words, F.lit(-1)), F.concat_ws(" ", F.try_element_at(words, F.lit(-2)), F.try_element_at(words, F.lit(-1)))))


def _mentions(text: Column, spans: Column, seed: bool) -> Column:
    """Spans with their instance (lower-cased, without quotes, brackets and end marks) and the patterns before them."""
    return F.transform(spans, lambda s: F.struct(
        F.when(F.lit(seed), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lower(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))).alias("instance"),
        _context(text, s["start"]).alias("patterns")))


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with one key are alike: it holds the id and a hash of the text."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, base, mentions`` of every row: the strict spans, and all seed and candidate mentions."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    free = F.when(F.col("text").rlike("[0-9@]"), _spans(F.col("text"), CANDIDATE, -1, lambda m: F.lit(True))).otherwise(
        F.array().cast(SPAN))
    rows = rows.withColumn("free", F.filter(free, lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    return rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "base", F.concat(
        _mentions(F.col("text"), F.col("base"), True), _mentions(F.col("text"), F.col("free"), False)).alias("mentions"))


def _lower_bound(known: Column, all_: Column) -> Column:
    """Wilson's lower bound (95 %) of a share."""
    z2, p = 1.96 ** 2, known / all_
    return (p + z2 / (2 * all_) - 1.96 * F.sqrt(p * (1 - p) / all_ + z2 / (4 * all_ * all_))) / (1 + z2 / all_)


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``key, kind, start, end`` of candidates behind high-confidence patterns; ``found`` is a written ``marked``.

    The graph's edges are distinct (pattern, instance) pairs. Each round scores patterns from the instances' scores, and
    then candidates from the patterns: an instance's score for a kind is one minus the product of its patterns'
    complements. Rounds are written, so no lineage grows.
    """
    mentions = found.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    edges = written(mentions.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(
        F.max("kind").alias("seed")), "pii-graph")
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.filter("seed is not null").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    scores, patterns = seeds, None
    for _ in range(rounds):
        mass = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        rated = mass.join(degree, "pattern").select(
            "pattern", "kind", _lower_bound(F.least("mass", "n"), F.col("n")).alias("score")).filter(F.col("score") >= HIGH)
        patterns = written(rated, "pii-patterns")
        reached = edges.filter("seed is null").join(patterns, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.lit(1.0) - F.col("score"))))).alias("score")).filter(F.col("score") >= SURE)
        scores = written(seeds.select("instance", "kind", "score").union(reached.select("instance", "kind", "score")), "pii-scores")
    candidates = mentions.filter("kind is null").select("key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    hits = candidates.join(patterns.select("pattern", F.col("kind").alias("found"), F.col("score").alias("by")), "pattern")
    # A candidate that patterns of several kinds find gets the kind of the surest one.
    return hits.groupBy("key", "start", "end").agg(F.max_by("found", F.struct("by", -F.col("found"))).alias("kind")).select(
        "key", "kind", "start", "end")


def _with_found(rows: DataFrame, base: str, extra: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: the base spans and those discovered under the row's key, by kind and start."""
    grouped = extra.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    return rows.join(grouped, "key", "left").withColumn(
        "spans", F.array_sort(F.concat(base, F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN))))).drop("more")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: strict spans, and all of them with what the patterns discovered.

    Spans are structs of the kind's place in ``KINDS`` and of start and end in code points. NULL and empty texts have
    none; repeated rows have the same; ids may be NULL; an empty table gives no rows; further columns are not read.
    """
    found = written(marked(docs, id_col, text_col), "pii-marked")
    return _with_found(found.select("doc_id", "key", "base"), "base", discovered(found)).select("doc_id", "base", "spans")


def counted(spans: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    code = list(KINDS).index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == code)).cast("long")


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's placeholder; of overlapping spans the first one names the whole."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("turned"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(PLACEHOLDERS[k]) for k in KINDS))
    state = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["turned"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out")))
    rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(state["out"], rest))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with every personal span of the text replaced; NULL texts stay NULL."""
    extra = written(discovered(written(marked(docs, id_col, text_col), "pii-marked")), "pii-found")
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), row_key(F.col(id_col), text).alias("key"), text.alias("whole"))
    spanned = _with_found(rows.withColumn("strict", base_spans(F.col("whole"))), "strict", extra)
    clean = F.when(F.col(f"row.{text_col}").isNotNull(), redacted(F.col("whole"), F.col("spans")))
    return spanned.select(*[clean.alias(n) if n == text_col else F.col("row")[n].alias(n) for n in names])
