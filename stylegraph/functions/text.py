"""Text rules over style sentences, generated answers and prompts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.operators.skew import lookup_join

# Names and wording that results and prompts must match.
LEVELS = ["Morphological Level", "Syntactic Level", "Semantic Level", "Discourse Level"]
DOCUMENT_SEPARATOR = " <new_documents> "
SENTENCE_PREFIX = "[SENTENCE]: "
PROMPTS = {
    "style": "[ATTRIBUTES]: Writing Style Attribute: {}",
    "style_topic": "[ATTRIBUTES]: Writing Style Attribute: {}, Topic Attribute: {}",
    "rewrite": "[ATTRIBUTES]: Writing Style Attribute: {}\n[TEXT]: {}\n\n",
    "shorten": "[SENTENCE]: {}",
    "features": "Text: {}\n\n Style Features:\n{}",
}
INSTRUCTIONS = {
    "style": "[TASK]: Please generate {} paragraphs. All paragraphs must have the provided writing style. Each paragraph should vary in topic and other style aspects.",
    "style_topic": "[TASK]: Please generate {} paragraphs. All paragraphs must have the provided writing style and topic.\nOnly return the generated paragraph.",
    "amplify": "[TASK]: Please rewrite the provided text to have the provided writing style.\nOnly return the generated paragraph.",
    "reduce": "[TASK]: Please rewrite the provided text by eliminating the provided writing style.\nOnly return the generated paragraph.",
    "rephrase": "[TASK]: Please rephrase the provided text while preserving its semantics.",
    "topic": "[TASK]: Answer with a single phrase. What is the main topic of this text?",
    "describe": "Please provide a list of writing style attributes that all of the given text has for each of the morphological, syntactic, semantic, and discourse levels. Each level should start with a paragraph heading then a list of short sentences describing the style where each sentence is in the format of \"The author is X.\" or \"The author uses X.\"",
    "shorten": "Please rewrite the provided sentence to be more generic and a short sentence that does not contain specifics or examples.",
    "to_paragraph": "Please rewrite the following list of writing style bullet points into a single paragraph.",
    "to_concise_paragraph": "Please rewrite the following list of writing style bullet points into a 1 to 3 sentences in the form of 'The author is X'",
    "to_sentence": "You are provided with a list of paragraphs which are describing the writing styles of a set of documents. Please rewrite and summarize the list of paragraphs into 2-3 sentences.",
    "common": "Please describe the common writing styles of the two texts on the following linguistic levels:\n1. Morphological level\n2. Syntactic level\n3. Semantic level\n4. Discourse level",
    "select": "Please select which of the following writing style attributes are the common attributes of the provided texts.\nWriting Style Attributes:\n{}",
    "rate": "You are a linguist expert. Your task is to read the text, and for each of the writing style features, give a score from 1 to 3. \n Score 1: The feature doesn't apply anywhere in the text \n Score 2: The feature appears somewhere in the text but not frequent \n Score 3: The feature often appears in the text",
}
UNFINISHED_TAGS = ["CCONJ", "SCONJ", "ADP", "PART", "DET", "PRON", "AUX", "INTJ", "ADJ", "ADV",
                   "NUM"]
UNFINISHED_PHRASES = ["such as", "including", "like", "especially", "without", "e.g.", "i.e.",
                      "among others", "such that", "such", "while", "where", "when", "because",
                      "as", "even though", "for example"]
UNFINISHED_LAST_TOKENS = [
    "with", "for", "to", "of", "in", "on", "at", "by", "about", "over", "under", "after",
    "between", "simply", "merely", "only", "almost", "nearly", "barely", "seldom", "informal",
    "directly", "regularly", "using", "employing", "considering", "following", "including",
    "utilizing", "featuring", "because", "although", "since", "unless", "whereas", "well", "so",
    "like"]
POSSESSIVE_TAGS = ["POS", "PRP$", "WP$"]
TRAILING_CONJUNCTIONS = ["and", "or", "but"]
OPENERS = ["according to", "based on", "due to", "in light of", "in accordance with",
           "as a result of"]
VERDICT_PATTERNS = [
    (r"(paragraph 1 better|\"paragraph 1\" better|\[paragraph 1\] better)", True),
    (r"(paragraph 2 better|\"paragraph 2\" better|\[paragraph 2\] better)", False),
    (r"^(paragraph 1|the first paragraph)", True),
    (r"^(paragraph 2|the second paragraph)", False),
]
MODEL_NAME = r"^[^:]+:[^:]+$"

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space of any script; none for blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def first_line(text: Column) -> Column:
    return strip(F.get(F.split(text, "\n"), F.lit(0)))


def word_difference(a: Column, b: Column) -> Column:
    """Positions whose words differ; the shorter text is padded."""
    pairs = F.zip_with(words(a), words(b), lambda x, y: ~x.eqNullSafe(y))
    return F.size(F.filter(pairs, lambda differs: differs)).cast("bigint")


def word_levenshtein(a: Column, b: Column) -> Column:
    """Character edit distance after collapsing whitespace."""
    return F.levenshtein(F.array_join(words(a), " "), F.array_join(words(b), " ")).cast("bigint")


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of lower-cased token sets; 0 when both are empty."""
    x, y = tokens(F.lower(a)), tokens(F.lower(b))
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def extract_levels(answer: Column) -> Column:
    """A generated answer as a map from each level to its sentences.

    Paragraphs alternate heading and list; an introduction starting with "Here"
    is skipped; unknown headings are ignored; a missing level holds "other".
    """
    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then(value)`` with the value computed once per row, however often it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def without_introduction(paragraphs: Column) -> Column:
        return F.when(F.startswith(F.get(paragraphs, F.lit(0)), F.lit("Here")),
                      F.slice(paragraphs, 2, F.greatest(F.size(paragraphs), F.lit(1)))
                      ).otherwise(paragraphs)

    def paired(body: Column) -> Column:
        return F.filter(F.transform(body, lambda p, i: F.struct(
            (i % 2).alias("odd"), F.replace(strip(F.replace(p, F.lit("**"), F.lit(""))), F.lit(":"),
                                            F.lit("")).alias("heading"),
            F.get(body, i + 1).alias("list"))), lambda b: (b["odd"] == 0) & b["list"].isNotNull())

    def sentences(text: Column) -> Column:
        return F.transform(F.split(text, "\n"), lambda line: strip(
            F.regexp_replace(line, r"[-*]", "")))

    def level(blocks: Column, name: str) -> Column:
        lists = F.transform(F.filter(blocks, lambda b: b["heading"] == name), lambda b: b["list"])
        return once(F.try_element_at(lists, F.lit(-1)), lambda found: F.when(
            found.isNotNull(), sentences(found)).otherwise(F.array(F.lit("other"))))

    def levels(blocks: Column) -> Column:
        return F.create_map(*[c for name in LEVELS for c in (F.lit(name), level(blocks, name))])

    body = once(F.split(answer, "\n\n"), without_introduction)
    return once(once(body, paired), levels)


def flatten_levels(levels: Column) -> Column:
    """All sentences of a level map as one list."""
    return F.flatten(F.map_values(levels))


def extract_markdown_attributes(answer: Column) -> Column:
    """Bold phrases, then starred lines, without remarks in parentheses."""
    bold = F.regexp_extract_all(answer, F.lit(r"\*\*(.*)\*\*"), F.lit(1))
    starred = F.regexp_extract_all(answer, F.lit(r"\n\*(.*)\n"), F.lit(1))
    found = F.transform(F.concat(bold, starred),
                        lambda x: strip(F.regexp_replace(x, r"\(.*\)", "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def parse_feature_scores(answer: Column, features: Column) -> Column:
    """Scores given per feature line, paired with the features in order."""
    digits = F.transform(F.split(answer, "\n"), lambda line: F.regexp_extract(
        line, r"feature-[\d]+: ([^\d]*)(\d)", 2))
    scores = F.filter(digits, lambda d: d != "")
    n = F.least(F.size(scores), F.size(features))
    return F.zip_with(F.slice(features, F.lit(1), n), F.slice(scores, F.lit(1), n),
                      lambda f, s: F.struct(f.alias("feature"), s.alias("score")))


def classify_verdict(response: Column) -> Column:
    """Struct of ``verdict`` (first paragraph is better) and ``matched``."""
    text = F.lower(response)
    first, second = text.contains("paragraph 1"), text.contains("paragraph 2")
    verdict = None
    for pattern, answer in VERDICT_PATTERNS:
        hit, value = text.rlike(pattern), F.lit(answer)
        verdict = F.when(hit, value) if verdict is None else verdict.when(hit, value)
    verdict = verdict.when(first, F.lit(True)).otherwise(F.lit(False))
    named = first | second
    for pattern, _ in VERDICT_PATTERNS:
        named = named | text.rlike(pattern)
    return F.struct(verdict.alias("verdict"), named.alias("matched"))


def rename_first_word(path: Column, word: str) -> Column:
    """Replace what comes before the first "-" in the file name."""
    return F.regexp_replace(path, r"^((?:.*/)?)[^/-]*(.*)$", F.lit(f"$1{word}$2"))


def valid_model_name(name: Column) -> Column:
    return name.rlike(MODEL_NAME)


def chunk_text(text: Column, ratio: int) -> Column:
    """Equal chunks of ``length // ratio`` characters; a shorter tail is dropped.

    Text with fewer characters than ``ratio`` has no chunks.
    """
    clean = F.replace(text, F.lit("<PERSON>"), F.lit(""))
    size = F.floor(F.length(clean) / ratio).cast("int")
    last = F.floor(F.length(clean) / size).cast("int") - 1
    steps = F.when(size > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.substring(clean, i * size + 1, size))


def render_prompt(template: str, *fields: Column) -> Column:
    """Fill the ``{}`` places of a named template, in order."""
    pieces = PROMPTS[template].split("{}")
    parts: list[Column] = []
    for piece, field in zip(pieces, [*fields, None]):
        if piece:
            parts.append(F.lit(piece))
        if field is not None:
            parts.append(field)
    return F.concat(*parts)


def numbered_concat(texts: Column) -> Column:
    """``Text 1: ...`` paragraphs."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(
        F.lit("Text "), (i + 1).cast("string"), F.lit(": "), t)), "\n\n")


def strip_prefix(text: Column) -> Column:
    return F.replace(text, F.lit(SENTENCE_PREFIX), F.lit(""))


def style_grid(rows: DataFrame, styles: Mapping[str, str]) -> DataFrame:
    """One request row per input row and style; ``styles`` maps name to wording."""
    listed = F.array(*[F.struct(F.lit(k).alias("style"), F.lit(v).alias("style_prompt"))
                       for k, v in styles.items()])
    return rows.withColumn("_s", F.explode(listed)).select("*", "_s.style", "_s.style_prompt").drop("_s")


def longest_first_dedupe(phrases: Column) -> Column:
    """Longest phrases first, without those contained in one already kept."""
    ordered = F.transform(F.array_sort(F.transform(phrases, lambda p, i: F.struct(
        (-F.length(p)).alias("size"), i.alias("at"), p.alias("phrase")))), lambda s: s["phrase"])
    empty = F.array().cast("array<string>")
    return F.aggregate(ordered, empty, lambda kept, p: F.when(
        F.exists(kept, lambda k: F.contains(k, p)), kept).otherwise(F.array_append(kept, p)))


def is_sentence_finished(df: DataFrame, text: str, lexicon: DataFrame, tags: DataFrame,
                         name: str = "finished") -> DataFrame:
    """Add whether a sentence looks complete; the first rule that applies decides.

    ``lexicon(word)`` lists valid words and ``tags(token, tag)`` the tags of
    tokens, both in lower case with one row per word.
    """
    raw = F.col(text)
    body = strip(raw)
    lower = F.lower(body)
    token = tokens(body)
    last = F.coalesce(F.lower(F.element_at(F.col("_tokens"), -1)), F.lit(""))
    last_word = F.regexp_replace(F.coalesce(F.element_at(words(body), -1), F.lit("")),
                                 r"^[.!?]+|[.!?]+$", "")
    rows = (df.withColumn("_tokens", F.when(F.length(body) > 0, token).otherwise(
        F.array().cast("array<string>")))
        .withColumn("_last", F.when(F.size("_tokens") > 0, last).otherwise(F.lit("")))
        .withColumn("_word", F.when(F.length(body) > 0, F.lower(last_word)).otherwise(F.lit(""))))
    known = lexicon.select(F.col("word").alias("_word"), F.lit(True).alias("_known"))
    tagged = tags.select(F.col("token").alias("_last"), F.col("tag").alias("_tag"))
    rows = lookup_join(lookup_join(rows, known, ["_word"], "left"), tagged, ["_last"], "left")

    def count(mark: str) -> Column:
        return F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))

    unbalanced = ((count("(") != count(")")) | (count('"') % 2 != 0) | (count("'") % 2 != 0)
                  | (count("[") != count("]")) | (count("{") != count("}")))
    n = F.size("_tokens")
    ends_open = F.lit(False)
    for phrase in UNFINISHED_PHRASES:
        ends_open = ends_open | lower.endswith(phrase)
    short_opener = F.lit(False)
    for opener in OPENERS:
        short_opener = short_opener | (lower.startswith(opener)
                                       & (n <= len(opener.split()) + 1))
    before = F.lower(F.get(F.col("_tokens"), n - 2))
    verdict = (
        F.when(F.length(body) == 0, False)
        .when(body.rlike(r"[.!?]$"), True)
        .when(F.col("_tag").isin(UNFINISHED_TAGS), False)
        .when(ends_open, False)
        .when((n > 1) & (F.length("_last") <= 2) & F.col("_last").rlike(r"[\p{L}\p{N}_]"), False)
        .when(F.col("_known").isNull(), False)
        .when(unbalanced, False)
        .when(F.col("_last").isin(UNFINISHED_LAST_TOKENS), False)
        .when(F.col("_tag").isin(POSSESSIVE_TAGS), False)
        .when((n > 1) & before.isin(TRAILING_CONJUNCTIONS), False)
        .when(short_opener, False)
        .otherwise(True))
    return rows.withColumn(name, verdict).drop("_tokens", "_last", "_word", "_known", "_tag")


def mine_phrases(features: DataFrame, lexicon: DataFrame, feature: str = "feature") -> DataFrame:
    """Noun phrases of each distinct feature: ``(feature, phrases)``.

    Patterns: ADJ NOUN+ ADV?, NOUN is ADV? ADJ, NOUN is ADV? NOUN. Tags come
    from ``lexicon(token, tag)``. A phrase inside a longer kept one is dropped.
    """
    distinct = features.select(F.col(feature).alias("feature")).distinct()
    spelled = distinct.select("feature", F.posexplode(tokens(F.lower("feature"))).alias("pos", "token"))
    tag = F.coalesce(F.col("tag"), F.lit("X"))
    code = (F.when(F.col("token") == "is", "i").when(tag == "ADJ", "a").when(tag == "NOUN", "n")
            .when(tag == "ADV", "r").otherwise("x"))
    rows = (lookup_join(spelled, lexicon.select("token", "tag"), ["token"], "left")
            .groupBy("feature").agg(F.array_sort(F.collect_list(
                F.struct("pos", "token", code.alias("code")))).alias("t")))
    codes = F.array_join(F.col("t.code"), "")
    # from each start, every pattern's longest span; shorter ones lie inside it
    spans = F.transform(F.col("t"), lambda t, i: F.regexp_extract(
        F.substring(codes, i + 1, F.length(codes)), r"^(an+r?|nir?[an])", 1))
    texts = F.transform(spans, lambda s, i: F.array_join(
        F.slice(F.col("t.token"), i + 1, F.length(s)), " "))
    found = F.filter(texts, lambda p: p != "")
    return rows.select("feature", longest_first_dedupe(found).alias("phrases"))
