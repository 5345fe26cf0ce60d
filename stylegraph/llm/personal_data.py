"""Personal data: fixed patterns, and bootstrapped contextual extraction beyond them.

Entities found by the fixed patterns are seeds. The two words before an entity are
its lexical pattern. On the graph of patterns and instances, a pattern's confidence is the
share of its occurrences in the corpus that introduce scored instances, and an unseen
identifier's score comes from the confidences of its patterns; both are
computed in turn. Identifiers that end above the threshold become spans. All
of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.llm.common import only
from stylegraph.operators.skew import lookup_join
from stylegraph.sources.staging import settle

KINDS = ("email", "ip", "card", "phone")
# Each finds what the contract's pattern finds, leftmost and non-overlapping, in linear
# time: a match begins at the start of a run or where the last match ended, and
# repetitions give nothing back.
_atext = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_atext}]))[{_atext}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_space, _word = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
#: Words that may be identifiers: with a digit or an @.
TOKEN = rf"(?<!{_word})[^{_space}0-9@]*+[0-9@]{_word}*+"
#: Characters before an entity that are searched for its two words; longest identifier.
REACH, LONGEST = 120, 64
#: Offsets are summed in blocks of this many hits.
BLOCK = 64
#: Patterns looked up in a list inside the expression at most (about 2 MB); beyond, by a join.
LISTED_PATTERNS = 20_000


def _luhn(hit: str) -> str:
    digits = f"reverse(regexp_replace({hit}, '[^0-9]', ''))"
    return (f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + "
            f"CASE WHEN i % 2 = 1 THEN cast(substring({digits}, i, 1) AS int) "
            f"ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({digits}, i, 1) AS int) + 1) END) % 10 = 0")


_part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID = {
    "email": "true",
    "ip": f"x.hit rlike '^{_part}(?:[.]{_part}){{3}}$'",
    "card": _luhn("x.hit"),
    "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 8 AND 15",
}


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(df: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds ``name``: array of ``(hit, start, end, before)`` of ``pattern`` in ``text``.

    Positions are code points, the end exclusive; ``before`` is the text since the last hit,
    cut to its last ``REACH`` characters.
    """
    rx = _sql_text(pattern)
    some = f"text rlike {_sql_text(hint)}"
    df = df.withColumn("_hits", F.expr(
        f"CASE WHEN {some} THEN regexp_extract_all(text, {rx}, 0) ELSE cast(array() AS array<string>) END"))
    df = df.withColumn("_gaps", F.expr(
        f"CASE WHEN size(_hits) > 0 THEN split(text, {rx}, -1) ELSE cast(array() AS array<string>) END"))
    df = df.withColumn("_lens", F.expr("transform(_hits, (h, i) -> length(_gaps[i]) + length(h))"))
    df = df.withColumn("_sums", F.expr(
        f"CASE WHEN size(_hits) = 0 THEN cast(array() AS array<int>) ELSE transform(sequence(0, (size(_hits) - 1) div {BLOCK}), "
        f"b -> aggregate(slice(_lens, cast(b AS int) * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x)) END"))
    start = (f"aggregate(slice(_sums, 1, cast(i div {BLOCK} AS int)), 0, (a, x) -> a + x) + "
             f"aggregate(slice(_lens, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK}), 0, (a, x) -> a + x) + length(_gaps[i])")
    df = df.withColumn(name, F.expr(
        f"transform(transform(_hits, (h, i) -> named_struct('hit', h, 'start', {start}, 'before', "
        f"substring(_gaps[i], -{REACH}, {REACH}))), "
        "x -> named_struct('hit', x.hit, 'start', x.start, 'end', x.start + length(x.hit), 'before', x.before))"))
    return df.drop("_hits", "_gaps", "_lens", "_sums")


def base_entities(docs: DataFrame) -> DataFrame:
    """Adds ``entities``: array of ``(kind, start, end, hit, before)`` by kind, then start.

    ``docs`` needs ``text`` without nulls; ``kind`` counts from 0 in the order of ``KINDS``.
    """
    parts = []
    for number, kind in enumerate(KINDS):
        docs = located(docs, f"_{kind}", PATTERNS[kind], HINTS[kind])
        parts.append(f"transform(filter(_{kind}, x -> {VALID[kind]}), x -> named_struct('kind', {number}, "
                     "'start', x.start, 'end', x.end, 'hit', x.hit, 'before', x.before))")
    docs = docs.withColumn("entities", F.expr(f"concat({', '.join(parts)})"))
    return docs.drop(*[f"_{k}" for k in KINDS])


def identifiers(docs: DataFrame) -> DataFrame:
    """Adds ``tokens``: words outside the entities that may be identifiers, ``(hit, start, end, before)``.

    They have an @ or at least four digits, and at most ``LONGEST`` characters; brackets,
    quotes and closing marks around them are left off.
    """
    docs = located(docs, "tokens", TOKEN, "[0-9@]")
    lead, tail = "'^[(\\\\[<\"]*'", "'[.,;:!?)\\\\]>\"]*$'"
    trimmed = ("transform(filter(tokens, t -> length(t.hit) <= %d), t -> named_struct("
               "'hit', regexp_replace(regexp_replace(t.hit, %s, ''), %s, ''), "
               "'start', t.start + length(t.hit) - length(regexp_replace(t.hit, %s, '')), 'before', t.before))"
               % (LONGEST, lead, tail, lead))
    docs = docs.withColumn("tokens", F.expr(
        f"transform({trimmed}, t -> named_struct('hit', t.hit, 'start', t.start, 'end', t.start + length(t.hit), "
        "'before', t.before))"))
    return docs.withColumn("tokens", F.expr(
        "filter(tokens, t -> (instr(t.hit, '@') > 0 OR length(regexp_replace(t.hit, '[^0-9]', '')) >= 4) "
        "AND NOT exists(entities, e -> e.start < t.end AND t.start < e.end))"))


def context(before: Column) -> Column:
    """The two words before an entity, lower-cased; null when there are fewer or none apart from it."""
    words = F.split(F.lower(before), f"[{_space}]+")
    # the entity must follow white space, so the last part is empty
    return F.when((F.size(words) >= 3) & (F.element_at(words, -1) == "") & (F.element_at(words, -3) != ""),
                  F.concat(F.element_at(words, -3), F.lit(" "), F.element_at(words, -2)))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each of ``patterns(pattern)`` is followed by a word."""
    words = docs.select(F.filter(F.split(F.lower("text"), f"[{_space}]+"), lambda w: w != "").alias("_w"))
    pairs = words.filter("size(_w) > 2").select(F.explode(F.expr(
        "transform(sequence(0, size(_w) - 3), i -> concat(_w[i], ' ', _w[i + 1]))")).alias("pattern"))
    listed = [r.pattern for r in patterns.limit(LISTED_PATTERNS + 1).collect()]
    if len(listed) <= LISTED_PATTERNS:       # a hash lookup, so that no matches become rows before they are counted
        met = pairs.filter(F.col("pattern").isin(listed))
    else:
        met = pairs.join(patterns, "pattern", "left_semi")
    return met.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def bootstrap(seeds: DataFrame, tokens: DataFrame, docs: DataFrame, rounds: int = 3,
              support: int = 3, threshold: float = 0.5) -> DataFrame | None:
    """Unseen identifiers ``(instance, kind)`` that patterns of the seeds introduce.

    ``seeds(pattern, instance, kind)`` and ``tokens(pattern, instance)`` hold occurrences.
    Patterns need ``support`` distinct instances. In each round a pattern's confidence per kind is the sum
    of its instances' scores over all its occurrences; a token's score is one minus the
    product of the doubts of its patterns. None when there is nothing to learn.
    """
    nodes = (seeds.select("pattern", "instance", "kind", F.lit(True).alias("seed"))
             .unionByName(tokens.select("pattern", "instance", F.lit(None).cast("int").alias("kind"),
                                        F.lit(False).alias("seed")))
             .filter("pattern is not null")
             .groupBy("pattern", "instance", "kind", "seed").agg(F.count(F.lit(1)).alias("n")))
    nodes = settle(nodes, "nodes")
    if nodes.filter("seed").isEmpty() or nodes.filter("not seed").isEmpty():
        return None
    common = settle(nodes.groupBy("pattern").agg(F.count(F.lit(1)).alias("_d")).filter(
        F.col("_d") >= support).select("pattern"), "patterns")
    # a pattern matters when it can reach a token and be reached from a seed; one that only seeds use cannot
    reach = settle(common.join(nodes.filter("not seed").select("pattern").distinct(), "pattern", "left_semi"), "reach")
    if reach.isEmpty():
        return None
    totals = settle(occurrences(docs, reach), "totals")
    edges = settle(lookup_join(nodes, totals, ["pattern"]), "edges")
    fixed = edges.filter("seed").groupBy("pattern", "kind").agg(F.sum("n").alias("mass"))
    scores = None
    for _ in range(rounds):
        mass = fixed.select("pattern", "kind", F.col("mass").cast("double").alias("mass"))
        if scores is not None:
            mass = mass.unionByName(lookup_join(
                edges.filter("not seed").select("pattern", "instance", "n"), scores, ["instance"]).select(
                "pattern", "kind", (F.col("n") * F.col("score")).alias("mass")))
        confidence = mass.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass")).join(totals, "pattern").select(
            "pattern", "kind", F.least(F.col("mass") / F.col("total"), F.lit(0.999)).alias("confidence"))
        scores = settle(edges.filter("not seed").select("pattern", "instance").join(confidence, "pattern")
                        .groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")), "scores")
    best = scores.filter(F.col("score") >= threshold).groupBy("instance").agg(
        F.max(F.struct("score", (-F.col("kind")).alias("_k"))).alias("_b"))
    return best.select("instance", (-F.col("_b._k")).alias("kind"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def span_text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', "
                  "cast(s.start AS string), ':', cast(s.end AS string))), ',')")


def learn(docs: DataFrame, slim: DataFrame) -> DataFrame | None:
    """``_key, added``: spans that bootstrapping adds per row; None when there are none."""
    entity = slim.select(F.explode("entities").alias("e")).select(
        context(F.col("e.before")).alias("pattern"), F.col("e.hit").alias("instance"), F.col("e.kind").alias("kind"))
    token = slim.select("_key", F.explode("tokens").alias("t"))
    found = bootstrap(entity, token.select(context(F.col("t.before")).alias("pattern"),
                                           F.col("t.hit").alias("instance")), docs)
    if found is None:
        return None
    spans = lookup_join(token.select("_key", F.col("t.hit").alias("instance"), F.col("t.start").alias("start"),
                                     F.col("t.end").alias("end")), found, ["instance"])
    return settle(spans.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")),
                  "added")


def prepared(docs: DataFrame) -> DataFrame:
    return (docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
            .withColumn("_key", row_key(F.col("doc_id").cast("bigint"), F.col("text"))))


def with_added(rows: DataFrame, added: DataFrame | None) -> DataFrame:
    bare = F.expr("transform(entities, e -> named_struct('kind', e.kind, 'start', e.start, 'end', e.end))")
    rows = rows.withColumn("base", bare)
    if added is None:
        return rows.withColumn("spans", F.col("base"))
    return rows.join(added, "_key", "left").withColumn(
        "spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of whole texts of ``docs(doc_id, text)``, one row per row.

    Returns ``doc_id, base, spans``: arrays of ``(kind, start, end)``, code points, by kind (0 email, 1 ip, 2 card,
    3 phone) and start; ``spans`` are the base spans with what bootstrapping adds. A null
    text is empty and has none. Null and repeated ids are rows like others; no rows
    give no rows.
    """
    docs = prepared(only(docs, doc_id="bigint", text="string"))
    slim = settle(identifiers(base_entities(docs)).select("doc_id", "_key", "entities", "tokens"), "entities")
    return with_added(slim, learn(docs, slim)).select("doc_id", "base", "spans")


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of the base spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS bigint)").alias(f"n_{k}")
              for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"),
                        span_text("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns stay as they are.

    Overlapping spans become one, named by the first. A null text stays null.
    """
    names = docs.columns
    rows = prepared(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                                F.col("doc_id"), F.col("text")))
    slim = settle(identifiers(base_entities(rows.select("doc_id", "text", "_key"))).select(
        "_key", "entities", "tokens"), "entities")
    found = with_added(base_entities(rows), learn(rows.select("text"), slim))
    found = found.withColumn("_runs", F.expr(
        "aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), "
        "cast(array() AS array<struct<start:int,end:int,kind:int>>), (a, s) -> "
        "CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1), "
        "array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), "
        "'kind', element_at(a, -1).kind))) ELSE concat(a, array(s)) END)"))
    labels = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    found = found.withColumn("_clean", F.expr(
        "CASE WHEN size(_runs) = 0 THEN text ELSE concat(array_join(transform(_runs, (r, i) -> concat("
        "substring(text, CASE WHEN i = 0 THEN 1 ELSE _runs[i - 1].end + 1 END, "
        "r.start - CASE WHEN i = 0 THEN 0 ELSE _runs[i - 1].end END), "
        f"element_at(array({labels}), r.kind + 1))), ''), substring(text, element_at(_runs, -1).end + 1)) END"))
    return found.select(*[
        F.when(F.col("_row.text").isNotNull(), F.col("_clean")).alias("text") if c == "text"
        else F.col(f"_row.`{c}`").alias(c) for c in names])
