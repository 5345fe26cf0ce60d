"""Queries over text rules; generated answers are composed from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylegraph.functions import text as X
from stylegraph.operators import tfidf
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.sources.tables import spread

TOKENS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"


def turns(t: Tables):
    """Each turn beside the next one of its conversation."""
    c = t.features
    n = c.select("document_id", (F.col("turn") - 1).alias("turn"), F.col("feature").alias("next"))
    return c.join(n, ["document_id", "turn"])


TURNS = """turns AS (SELECT a.document_id, a.turn, a.feature, b.feature AS next FROM features a
    JOIN features b ON b.document_id = a.document_id AND b.turn = a.turn + 1)"""


@query("first_line", r"""SELECT conv_id AS document_id, turn,
    regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS feature FROM conversations""")
def _first_line(t: Tables):
    return t.conversations.select(F.col("conv_id").alias("document_id"), "turn",
                                  X.first_line(F.col("text")).alias("feature"))


@query("word_difference", with_("features", extra=TURNS) + r"""
    SELECT document_id, turn, len(list_filter(generate_series(1, greatest(len(a), len(b))),
        lambda i: a[i] IS DISTINCT FROM b[i])) AS words FROM (
    SELECT document_id, turn, list_filter(string_split_regex(feature, '\s+'), lambda w: w <> '') AS a,
        list_filter(string_split_regex(next, '\s+'), lambda w: w <> '') AS b FROM turns)""")
def _word_difference(t: Tables):
    return turns(t).select("document_id", "turn", X.word_difference(
        F.col("feature"), F.col("next")).alias("words"))


@query("word_levenshtein", r"""SELECT p_partkey, levenshtein(p_name,
    p_type || ' ' || p_brand) AS edits FROM part""")
def _word_levenshtein(t: Tables):
    spaced = F.concat(F.lit("  "), "p_type", F.lit(" \t "), "p_brand")
    return t.part.select("p_partkey", X.word_levenshtein(F.col("p_name"), spaced).alias("edits"))


@query("token_overlap", with_("features", extra=TURNS) + f"""
    SELECT document_id, turn, round(CASE WHEN len(list_distinct(a || b)) > 0
        THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 6) AS overlap FROM (
    SELECT document_id, turn, list_distinct(regexp_extract_all(lower(feature), {TOKENS})) AS a,
        list_distinct(regexp_extract_all(lower(next), {TOKENS})) AS b FROM turns)""")
def _token_overlap(t: Tables):
    return turns(t).select("document_id", "turn", r6(
        X.token_overlap(F.col("feature"), F.col("next")), "overlap"))


def answers(t: Tables):
    """A level answer per part; some lack an introduction or a level."""
    intro = F.when(F.col("p_size") % 2 == 0, "Here are the levels:\n\n").otherwise("")
    odd = F.when(F.col("p_size") % 3 == 0, "Syntactic Level:").otherwise("Tonal Level:")
    return spread(t.part).select("p_partkey", F.concat(
        intro, F.lit("**Morphological Level:**\n\n- "), "p_name", F.lit("\n* "), "p_type",
        F.lit("\n\n"), odd, F.lit("\n\n- **"), "p_brand", F.lit("**\n\nDiscourse Level\n\n"),
        "p_name").alias("answer"))


_LEVELS = """levels AS (
    SELECT p_partkey, 'Morphological Level' AS level, 0 AS pos, p_name AS feature FROM part
    UNION ALL SELECT p_partkey, 'Morphological Level', 1, p_type FROM part
    UNION ALL SELECT p_partkey, 'Syntactic Level', 0,
        CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'other' END FROM part
    UNION ALL SELECT p_partkey, 'Semantic Level', 0, 'other' FROM part
    UNION ALL SELECT p_partkey, 'Discourse Level', 0, p_name FROM part)"""


@query("extract_levels", f"WITH {_LEVELS} SELECT p_partkey, level, pos, feature FROM levels")
def _extract_levels(t: Tables):
    rows = answers(t).select("p_partkey", F.explode(X.extract_levels(F.col("answer"))).alias("level", "l"))
    return rows.select("p_partkey", "level", F.posexplode("l").alias("pos", "feature"))


@query("flatten_levels", f"""WITH {_LEVELS} SELECT p_partkey, row_number() OVER (
    PARTITION BY p_partkey ORDER BY list_position(['Morphological Level', 'Syntactic Level',
    'Semantic Level', 'Discourse Level'], level), pos) - 1 AS pos, feature FROM levels""")
def _flatten_levels(t: Tables):
    flat = X.flatten_levels(X.extract_levels(F.col("answer")))
    rows = answers(t).select("p_partkey", F.posexplode(flat).alias("pos", "feature"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("expand_rows", f"WITH {_LEVELS} SELECT p_partkey, level, feature FROM levels")
def _expand_rows(t: Tables):
    rows = answers(t).select("p_partkey", F.explode(X.extract_levels(F.col("answer"))).alias("level", "l"))
    return rows.select("p_partkey", "level", F.explode("l").alias("feature"))


@query("feature_level", f"""WITH {_LEVELS} SELECT feature, arg_max(level, p_partkey * 100
    + list_position(['Morphological Level', 'Syntactic Level', 'Semantic Level',
    'Discourse Level'], level) * 10 + pos) AS level FROM levels GROUP BY feature""")
def _feature_level(t: Tables):
    maps = answers(t).select("p_partkey", X.extract_levels(F.col("answer")).alias("level_map"))
    return tfidf.feature_level(maps, "p_partkey")


@query("extract_markdown_attributes", """SELECT p_partkey, pos, attribute FROM (
    SELECT p_partkey, 0 AS pos, CASE WHEN p_size % 4 = 0 THEN 'other' ELSE p_name END AS attribute FROM part
    UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 4 <> 0)""")
def _markdown(t: Tables):
    marked = F.concat(F.lit("These hold: **"), "p_name", F.lit(" (often)**\n* "), "p_type",
                      F.lit(" (e.g. here)\nDone."))
    answer = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(marked)
    return t.part.select("p_partkey", F.posexplode(
        X.extract_markdown_attributes(answer)).alias("pos", "attribute"))


@query("parse_feature_scores", """SELECT p_partkey, feature, score FROM (
    SELECT p_partkey, p_name AS feature, (p_size % 3 + 1)::VARCHAR AS score FROM part
    UNION ALL SELECT p_partkey, p_type, '2' FROM part)""")
def _feature_scores(t: Tables):
    answer = F.concat(F.lit("feature-1: "), "p_name", F.lit(" - Score: "),
                      (F.col("p_size") % 3 + 1).cast("string"),
                      F.lit("\nnothing to see\nfeature-2: applies 2 of 3"))
    pairs = X.parse_feature_scores(answer, F.array("p_name", "p_type", "p_brand"))
    return t.part.select("p_partkey", F.explode(pairs).alias("e")).select(
        "p_partkey", "e.feature", "e.score")


def responses(t: Tables):
    said = (F.when(F.col("event_type") == "view", "I find [Paragraph 1] better here")
            .when(F.col("event_type") == "purchase", "The second paragraph is clearer")
            .when(F.col("event_type") == "click", "Both fine, paragraph 2 maybe")
            .when(F.col("event_type") == "signup", "Paragraph 1, though paragraph 2 better written")
            .otherwise("No idea"))
    return t.events.select("event_id", "event_type", said.alias("response"))


_VERDICTS = """verdicts AS (SELECT event_id, event_type IN ('view') AS verdict,
    event_type IN ('view', 'purchase', 'click', 'signup') AS matched FROM events)"""


@query("classify_verdict", f"WITH {_VERDICTS} SELECT event_id, verdict, matched FROM verdicts")
def _classify_verdict(t: Tables):
    rows = responses(t).withColumn("v", X.classify_verdict(F.col("response")))
    return rows.select("event_id", "v.verdict", "v.matched")


@query("verdict_rates", f"""WITH {_VERDICTS} SELECT count(*) FILTER (WHERE verdict) AS correct,
    count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS missing,
    round(avg(CASE WHEN verdict THEN 1 ELSE 0 END), 6) AS rate FROM verdicts""")
def _verdict_rates(t: Tables):
    rows = responses(t).withColumn("v", X.classify_verdict(F.col("response")))
    return rows.agg(F.count_if("v.verdict").alias("correct"), F.count_if("v.matched").alias("matched"),
                    F.count_if(~F.col("v.matched")).alias("missing"),
                    r6(F.avg(F.col("v.verdict").cast("int")), "rate"))


@query("rename_first_word", """SELECT doc_id, '/data/' || lang || '/' || 'styles-' || doc_id
    || '-x.jsonl' AS path FROM documents""")
def _rename(t: Tables):
    path = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("-"),
                    F.col("doc_id").cast("string"), F.lit("-x.jsonl"))
    return t.documents.select("doc_id", X.rename_first_word(path, "styles").alias("path"))


@query("valid_model_name", """SELECT p_partkey, regexp_full_match(name, '[^:]+:[^:]+') AS valid
    FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ':' || p_type WHEN 1 THEN p_brand
    ELSE p_brand || ':' || p_type || ':' END AS name FROM part)""")
def _valid_model_name(t: Tables):
    third = F.col("p_size") % 3
    full = F.concat("p_brand", F.lit(":"), "p_type")
    name = F.when(third == 0, full).when(third == 1, F.col("p_brand")).otherwise(
        F.concat(full, F.lit(":")))
    return t.part.select("p_partkey", X.valid_model_name(name).alias("valid"))


@query("chunk_text", """SELECT doc_id, i AS chunk, md5(substring(text, i * size + 1, size)) AS hash
    FROM (SELECT doc_id, text, size, unnest(generate_series(0, length(text) // size - 1)) AS i FROM (
    SELECT doc_id, replace(text, '<PERSON>', '') AS text,
        length(replace(text, '<PERSON>', '')) // 4 AS size FROM documents) WHERE size > 0)""")
def _chunk_text(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(X.chunk_text(F.col("text"), 4)).alias("chunk", "c"))
    return rows.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.md5("c").alias("hash"))


@query("render_prompt", r"""SELECT doc_id, md5('[ATTRIBUTES]: Writing Style Attribute: ' || upper(source)
    || chr(10) || '[TEXT]: ' || text || chr(10) || chr(10)) AS rewrite,
    '[ATTRIBUTES]: Writing Style Attribute: ' || upper(lang) || ', Topic Attribute: ' || source AS styled
    FROM documents""")
def _render_prompt(t: Tables):
    return t.documents.select(
        "doc_id", F.md5(X.render_prompt("rewrite", F.upper("source"), F.col("text"))).alias("rewrite"),
        X.render_prompt("style_topic", F.upper("lang"), F.col("source")).alias("styled"))


@query("numbered_concat", r"""SELECT conv_id, md5(string_agg('Text ' || (turn + 1) || ': ' || text,
    chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id""")
def _numbered_concat(t: Tables):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "text"))).alias("l"))
    return lists.select("conv_id", F.md5(X.numbered_concat(F.col("l.text"))).alias("prompt"))


@query("strip_prefix", "SELECT conv_id, turn, text AS sentence FROM conversations")
def _strip_prefix(t: Tables):
    prompt = X.render_prompt("shorten", F.col("text"))
    return t.conversations.select("conv_id", "turn", X.strip_prefix(prompt).alias("sentence"))


STYLES = {"plain": "The author is plain.", "formal": "The author is formal."}


@query("style_topic_grid", """SELECT doc_id, style, style_prompt, upper(style_prompt) || ' ' || source AS request
    FROM documents, (VALUES ('plain', 'The author is plain.'), ('formal', 'The author is formal.'))
    AS s(style, style_prompt)""")
def _style_grid(t: Tables):
    rows = X.style_grid(t.documents.select("doc_id", "source"), STYLES)
    return rows.select("doc_id", "style", "style_prompt", F.concat(
        F.upper("style_prompt"), F.lit(" "), "source").alias("request"))


@query("round3", "SELECT p_partkey, round(p_retailprice / 7, 3) AS price FROM part")
def _round3(t: Tables):
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") / 7, 3).alias("price"))


@query("longest_first_dedupe", with_("features") + """,
    spelled AS (SELECT document_id, turn, feature AS phrase FROM features),
    kept AS (SELECT a.document_id, a.phrase, a.turn FROM spelled a WHERE NOT EXISTS (
        SELECT 1 FROM spelled b WHERE b.document_id = a.document_id AND b.turn <> a.turn
        AND contains(b.phrase, a.phrase) AND (length(b.phrase) > length(a.phrase)
        OR (length(b.phrase) = length(a.phrase) AND b.turn < a.turn))))
    SELECT document_id, row_number() OVER (PARTITION BY document_id
        ORDER BY length(phrase) DESC, turn) - 1 AS pos, phrase FROM kept""")
def _longest_first(t: Tables):
    lists = t.features.groupBy("document_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "feature"))).alias("l"))
    rows = lists.select("document_id", F.posexplode(
        X.longest_first_dedupe(F.col("l.feature"))).alias("pos", "phrase"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("mine_phrases", r"""WITH lexicon AS (
        SELECT DISTINCT split_part(p_name, ' ', 1) AS token, 'ADJ' AS tag FROM part
        UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'NOUN' FROM part
        UNION SELECT DISTINCT lower(p_type), 'ADJ' FROM part
        UNION SELECT 'brand', 'NOUN' UNION SELECT 'very', 'ADV'),
    sentences AS (SELECT DISTINCT p_name || ' is very ' || lower(p_type) || ' brand' AS feature FROM part),
    spelled AS (SELECT feature, unnest(t) AS token, unnest(generate_series(1, len(t))) AS pos FROM (
        SELECT feature, string_split(feature, ' ') AS t FROM sentences)),
    coded AS (SELECT s.feature, string_agg(CASE WHEN s.token = 'is' THEN 'i' WHEN l.tag = 'ADJ' THEN 'a'
        WHEN l.tag = 'NOUN' THEN 'n' WHEN l.tag = 'ADV' THEN 'r' ELSE 'x' END, '' ORDER BY pos) AS codes,
        list(s.token ORDER BY pos) AS t FROM spelled s LEFT JOIN lexicon l ON l.token = s.token
        GROUP BY s.feature),
    spans AS (SELECT feature, i, array_to_string(list_slice(t, i, i - 1 + length(
        regexp_extract(substring(codes, i), '^(an+r?|nir?[an])'))), ' ') AS phrase FROM (
        SELECT feature, codes, t, unnest(generate_series(1, len(t))) AS i FROM coded)
        WHERE regexp_extract(substring(codes, i), '^(an+r?|nir?[an])') <> '')
    SELECT a.feature, a.phrase FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b
        WHERE b.feature = a.feature AND b.i <> a.i AND contains(b.phrase, a.phrase)
        AND (length(b.phrase) > length(a.phrase) OR (length(b.phrase) = length(a.phrase) AND b.i < a.i)))""")
def _mine_phrases(t: Tables):
    name = F.split("p_name", " ")
    constant = t.part.select(F.explode(F.array(
        F.struct(F.lit("brand").alias("token"), F.lit("NOUN").alias("tag")),
        F.struct(F.lit("very").alias("token"), F.lit("ADV").alias("tag")))).alias("e")).select("e.*")
    lexicon = (t.part.select(name[0].alias("token"), F.lit("ADJ").alias("tag"))
               .union(t.part.select(name[1], F.lit("NOUN")))
               .union(t.part.select(F.lower("p_type"), F.lit("ADJ"))).union(constant).distinct())
    rows = t.part.select(F.concat("p_name", F.lit(" is very "), F.lower("p_type"),
                                  F.lit(" brand")).alias("feature"))
    mined = X.mine_phrases(rows, lexicon)
    return mined.select("feature", F.explode("phrases").alias("phrase"))


_FINISHED = r"""raw AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?]')) AS sentence FROM conversations
        UNION ALL SELECT conv_id, turn, text FROM conversations
        UNION ALL SELECT conv_id, turn, 'based on ' || role FROM conversations),
    sentences AS (SELECT DISTINCT sentence, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS body FROM raw),
    words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM benchmark),
    tags AS (SELECT word AS token, CASE WHEN length(word) = 2 THEN 'ADP' WHEN length(word) = 3 THEN 'DET'
        WHEN length(word) = 4 THEN 'POS' ELSE 'NOUN' END AS tag FROM words),
    cut AS (SELECT sentence, body, lower(body) AS low, regexp_extract_all(body, TOKENS) AS t,
        coalesce(lower(list_filter(string_split_regex(body, '\s+'), lambda w: w <> '')[-1]), '') AS lastw FROM sentences),
    ready AS (SELECT c.*, len(t) AS n, CASE WHEN len(t) > 0 THEN lower(t[-1]) ELSE '' END AS last,
        regexp_replace(lastw, '^[.!?]+|[.!?]+$', '', 'g') AS word FROM cut c)
    SELECT r.sentence, CASE WHEN length(body) = 0 THEN false
        WHEN regexp_matches(body, '[.!?]$') THEN true
        WHEN g.tag IN ('CCONJ','SCONJ','ADP','PART','DET','PRON','AUX','INTJ','ADJ','ADV','NUM') THEN false
        WHEN regexp_matches(low, '(such as|including|like|especially|without|e\.g\.|i\.e\.|among others|such that|such|while|where|when|because|as|even though|for example)$') THEN false
        WHEN n > 1 AND length(last) <= 2 AND regexp_matches(last, '[\p{L}\p{N}_]') THEN false
        WHEN w.word IS NULL THEN false
        WHEN length(replace(sentence, '(', '')) <> length(replace(sentence, ')', '')) THEN false
        WHEN (length(sentence) - length(replace(sentence, '"', ''))) % 2 <> 0 THEN false
        WHEN (length(sentence) - length(replace(sentence, '''', ''))) % 2 <> 0 THEN false
        WHEN length(replace(sentence, '[', '')) <> length(replace(sentence, ']', '')) THEN false
        WHEN length(replace(sentence, '{', '')) <> length(replace(sentence, '}', '')) THEN false
        WHEN list_contains(ENDINGS, last) THEN false
        WHEN g.tag IN ('POS', 'PRP$', 'WP$') THEN false
        WHEN n > 1 AND lower(t[-2]) IN ('and', 'or', 'but') THEN false
        WHEN starts_with(low, 'according to') AND n <= 3 THEN false
        WHEN starts_with(low, 'based on') AND n <= 3 THEN false
        WHEN starts_with(low, 'due to') AND n <= 3 THEN false
        WHEN starts_with(low, 'in light of') AND n <= 4 THEN false
        WHEN starts_with(low, 'in accordance with') AND n <= 4 THEN false
        WHEN starts_with(low, 'as a result of') AND n <= 5 THEN false
        ELSE true END AS finished
    FROM ready r LEFT JOIN words w ON w.word = r.word LEFT JOIN tags g ON g.token = r.last"""


@query("is_sentence_finished", "WITH " + _FINISHED.replace("TOKENS", TOKENS).replace(
    "ENDINGS", str(X.UNFINISHED_LAST_TOKENS)))
def _finished(t: Tables):
    c = t.conversations
    raw = (c.select(F.explode(F.split("text", "[.!?]")).alias("sentence"))
           .union(c.select("text")).union(c.select(F.concat(F.lit("based on "), "role")))).distinct()
    lexicon = lexicon_words(t)
    n = F.length("word")
    tags = lexicon.select(F.col("word").alias("token"), F.when(n == 2, "ADP").when(n == 3, "DET")
                          .when(n == 4, "POS").otherwise("NOUN").alias("tag"))
    return X.is_sentence_finished(raw, "sentence", lexicon, tags)


def lexicon_words(t: Tables):
    listed = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return t.benchmark.select(F.explode(listed).alias("word")).select(
        F.lower("word").alias("word")).distinct()
