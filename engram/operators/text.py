"""Tagging and enrichment of texts: native column expressions in one pass over a table."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import fixed, views
from engram.registry import query

QUOTE = "'"


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words, ASCII case ignored; read alike by Spark and by DuckDB."""
    return f"(?i)(?:^|[^A-Za-z0-9_])(?:{'|'.join(phrases)})(?:[^A-Za-z0-9_]|$)"


def sql_text(value: str) -> str:
    return QUOTE + value.replace(QUOTE, QUOTE * 2) + QUOTE


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def first_match(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class with a phrase in the text."""
    out = None
    for name, phrases in classes:
        hit = text.rlike(phrase_pattern(phrases))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def sql_first_match(text: str, classes: list[tuple[str, list[str]]], default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, {sql_text(phrase_pattern(p))}) THEN {sql_text(n)}" for n, p in classes)
    return f"CASE {cases} ELSE {sql_text(default)} END"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))


SQL_WORDS = r"regexp_extract_all(lower({}), '[^ \t\n\r\f\x0B]+')"


def chunk_turns(turns: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """Windows of `size` ordered turns that overlap; a rest of at most `overlap` new turns goes to the last window."""
    step = size - overlap
    w = W.partitionBy("session_id")
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("turn")) - 1
    chunks = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap - overlap) / step)).cast("long")
    held = turns.withColumn("n", n).withColumn("i", i).withColumn("chunks", chunks)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step))
    hi = F.least(F.col("chunks") - 1, F.floor(F.col("i") / step))
    spread = held.withColumn("chunk", F.explode(F.sequence(F.least(lo, hi), hi)))
    return spread.groupBy("session_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(
    "E1_chunk_turns",
    """WITH t AS (SELECT session_id, turn, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS i FROM turns),
    c AS (SELECT *, greatest(1, ceil((n - 4) / 8.0))::BIGINT AS chunks FROM t), k AS (SELECT unnest(range(0, 10000)) AS chunk)
    SELECT session_id, chunk::BIGINT AS chunk, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM c JOIN k ON k.chunk < chunks
    WHERE i >= k.chunk * 8 AND (i < k.chunk * 8 + 10 OR k.chunk = chunks - 1) GROUP BY session_id, chunk""",
)
def e1_chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_turns(views.turns(spark, sf_dir))


def sentences(facts: DataFrame) -> DataFrame:
    """(fact_id, position, sentence): texts cut at sentence marks and line ends, pieces under 20 characters dropped."""
    pieces = F.split(F.col("content"), r"[.!?\n]+")
    each = facts.select("fact_id", F.posexplode(pieces).alias("position", "sentence"))
    return each.select("fact_id", F.col("position").cast("long").alias("position"), F.trim("sentence").alias("sentence")).where(F.length("sentence") >= 20)


ENTITY = r"[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}|[A-Z]{2,}"
NO_ENTITIES = ["The", "This", "That", "To", "Of", "And", "Is", "It", "In"]


def entities(text: Column) -> Column:
    """Distinct capitalised spans, sorted, without stop words."""
    return F.array_sort(F.array_distinct(F.array_except(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array(*map(F.lit, NO_ENTITIES)))))


SQL_ENTITIES = f"list_sort(list_distinct(list_filter(regexp_extract_all(content, '{ENTITY}'), lambda x: NOT list_contains({sql_list(NO_ENTITIES)}, x))))"


@query("E3_extract_entities", f"SELECT fact_id, len(e)::BIGINT AS n_entities, coalesce(array_to_string(e, '|'), '') AS entities FROM (SELECT fact_id, {SQL_ENTITIES} AS e FROM facts)")
def e3_extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.facts(spark, sf_dir).select("fact_id", entities(F.col("content")).alias("e"))
    return found.select("fact_id", F.size("e").cast("long").alias("n_entities"), F.array_join("e", "|").alias("entities"))


SENTENCE_CLASSES = [("temporal", fixed.TEMPORAL_MARKERS), ("opinion", fixed.OPINION_MARKERS), ("episodic", fixed.EXPERIENCE_MARKERS)]
ROUTE_CLASSES = [("opinion", fixed.ROUTE_OPINION), ("temporal", fixed.ROUTE_TEMPORAL), ("episodic", fixed.ROUTE_EPISODIC)]


@query("E4_classify_sentence", f"SELECT fact_id, {sql_first_match('content', SENTENCE_CLASSES, 'semantic')} AS class FROM facts")
def e4_classify_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("fact_id", first_match(F.col("content"), SENTENCE_CLASSES, "semantic").alias("class"))


@query("E5_route_type_keywords", f"SELECT fact_id, {sql_first_match('content', ROUTE_CLASSES, 'semantic')} AS class FROM facts")
def e5_route_type_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("fact_id", first_match(F.col("content"), ROUTE_CLASSES, "semantic").alias("class"))


@query(
    "E7_score_importance",
    f"""WITH e AS (SELECT fact_id, session_id, content, {SQL_ENTITIES} AS names FROM facts),
    x AS (SELECT session_id, unnest(names) AS name FROM e), f AS (SELECT session_id, name, count(*) AS n FROM x GROUP BY session_id, name),
    t AS (SELECT session_id, sum(n) AS total FROM f GROUP BY session_id), own AS (SELECT fact_id, session_id, unnest(names) AS name FROM e),
    m AS (SELECT own.fact_id, max(f.n) AS most FROM own JOIN f ON own.session_id = f.session_id AND own.name = f.name GROUP BY own.fact_id)
    SELECT e.fact_id, round(least(1.0, 0.3 + CASE WHEN list_has_any({SQL_WORDS.format('content')}, {sql_list(fixed.EMOTIONAL_WORDS)}) THEN 0.2 ELSE 0 END
      + CASE WHEN regexp_matches(content, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 0.2 ELSE 0 END + 0.3 * coalesce(most, 0)::DOUBLE / coalesce(total, 1)::DOUBLE), 3)::DOUBLE AS importance
    FROM e LEFT JOIN m ON e.fact_id = m.fact_id LEFT JOIN t ON e.session_id = t.session_id""",
)
def e7_score_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.3, 0.2 for an emotional word, 0.2 for a date, up to 0.3 for the entity that is most frequent in the session."""
    named = views.facts(spark, sf_dir).select("fact_id", "session_id", "content", entities(F.col("content")).alias("names"))
    own = named.select("fact_id", "session_id", F.explode("names").alias("name"))
    often = own.groupBy("session_id", "name").agg(F.count("*").alias("n"))
    total = often.groupBy("session_id").agg(F.sum("n").alias("total"))
    most = own.join(often, ["session_id", "name"]).groupBy("fact_id").agg(F.max("n").alias("most"))
    emotion = F.when(F.arrays_overlap(words(F.col("content")), F.array(*map(F.lit, fixed.EMOTIONAL_WORDS))), 0.2).otherwise(0.0)
    dated = F.when(F.col("content").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0.2).otherwise(0.0)
    score = 0.3 + emotion + dated + 0.3 * F.coalesce("most", F.lit(0)) / F.coalesce("total", F.lit(1))
    return named.join(most, "fact_id", "left").join(total, "session_id", "left").select("fact_id", F.round(F.least(F.lit(1.0), score), 3).alias("importance"))


SIGNAL_CLASSES = list(fixed.SIGNALS.items())


@query("E8_infer_signal", f"SELECT fact_id, {sql_first_match('content', SIGNAL_CLASSES, 'factual')} AS signal FROM facts")
def e8_infer_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).select("fact_id", first_match(F.col("content"), SIGNAL_CLASSES, "factual").alias("signal"))


POSITIVE = ["love", "amazing", "wonderful", "excited", "happy", "thrilled", "grateful", "proud", "best", "incredible", "fantastic"]
NEGATIVE = ["hate", "terrible", "awful", "angry", "sad", "scared", "devastated", "furious", "anxious", "disappointed", "worst", "horrible", "miserable", "stupid", "trash", "pathetic"]


@query(
    "E9_tag_emotion",
    f"""WITH w AS (SELECT fact_id, list_distinct({SQL_WORDS.format('content')}) AS w FROM facts),
    c AS (SELECT fact_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({sql_list(POSITIVE)}, x))) AS p, len(list_filter(w, lambda x: list_contains({sql_list(NEGATIVE)}, x))) AS q FROM w),
    e AS (SELECT fact_id, CASE WHEN p + q = 0 THEN 0.0::DOUBLE ELSE round((p - q)::DOUBLE / (p + q), 4) END AS valence, round(least(1.0, 2.0 * (p + q)::DOUBLE / greatest(n, 1)), 4) AS arousal FROM c)
    SELECT fact_id, valence, arousal::DOUBLE AS arousal, round(CASE WHEN arousal > 0.2 THEN least(0.3, 0.3 * arousal) ELSE 0 END, 6)::DOUBLE AS boost FROM e""",
)
def e9_tag_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valence and arousal by word lists (a caller's own, in general), and the importance that arousal adds."""
    w = F.array_distinct(words(F.col("content")))
    counted = views.facts(spark, sf_dir).select("fact_id", w.alias("w")).select(
        "fact_id", F.size("w").alias("n"), F.size(F.array_intersect("w", F.array(*map(F.lit, POSITIVE)))).alias("p"), F.size(F.array_intersect("w", F.array(*map(F.lit, NEGATIVE)))).alias("q")
    )
    found = F.col("p") + F.col("q")
    tagged = counted.select(
        "fact_id", F.when(found == 0, 0.0).otherwise(F.round((F.col("p") - F.col("q")) / found, 4)).alias("valence"), F.round(F.least(F.lit(1.0), 2.0 * found / F.greatest("n", F.lit(1))), 4).alias("arousal")
    )
    return tagged.withColumn("boost", F.round(F.when(F.col("arousal") > 0.2, F.least(F.lit(0.3), 0.3 * F.col("arousal"))).otherwise(0.0), 6))


def sql_redact(text: str) -> str:
    for kind, pattern in fixed.PII:
        text = f"regexp_replace({text}, {sql_text(pattern)}, '[REDACTED:{kind}]', 'g')"
    return text


def redact(text: Column) -> Column:
    for kind, pattern in fixed.PII:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


@query("E13_redact_pii", f"SELECT fact_id, md5({sql_redact('content')}) AS redacted_md5, {sql_redact('content')} <> content AS has_pii FROM facts")
def e13_redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    clean = redact(F.col("content"))
    return views.facts(spark, sf_dir).select("fact_id", F.md5(clean).alias("redacted_md5"), (clean != F.col("content")).alias("has_pii"))


def sql_secrets(text: str) -> str:
    for kind, pattern in SECRETS:
        text = f"regexp_replace({text}, {sql_text(pattern)}, '[REDACTED:{kind}:\\1]', 'g')"
    return text


_BLANK = r" \t\n\r\f\x0B"
#: Kinds of tokens that make a topic, as patterns with what stands in their first group; whole words are tested by themselves.
_WORD_RUN, _IDENTIFIER = r"([\p{L}\p{N}_]+)", "^[A-Z][a-zA-Z0-9]+[A-Z][a-zA-Z0-9]*$"
_LINKS = [rf"(https?://[^{_BLANK}<>]+)", rf"(/[^{_BLANK}/<>]+(?:/[^{_BLANK}/<>]+)*(?:\.[A-Za-z0-9]+)?)"]
_QUOTED = [r'"([^"]{1,200})"', "'([^']{1,200})'"]
_TOPIC_WORD = r"([A-Za-z0-9][A-Za-z0-9'-]{2,})"
#: Characters of a text that its signature reads.
TOPIC_CHARS = 4_000


def topic_signature(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 over six groups of a text's first 4,000 characters, each sorted and distinct:
    identifiers of two humps, addresses, paths, quotations, content words, and pairs of content words in a row.

    Texts are composed (NFC) first, for which only those beyond ASCII go to a Python worker. Empty and null texts have 0s.
    """

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    cut = F.substring(text, 1, TOPIC_CHARS)
    beyond = cut.rlike(r"[^\x00-\x7F]")
    t = F.coalesce(composed(F.when(beyond, cut)), cut)
    found = lambda p, of=t: F.regexp_extract_all(of, F.lit(p), F.lit(1))
    words = F.filter(found(_TOPIC_WORD, F.lower(t)), lambda w: ~w.isin(fixed.TOPIC_STOP_WORDS))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1_000_000), lambda x, y: F.concat_ws("_", x, y))
    groups = [F.filter(found(_WORD_RUN), lambda w: w.rlike(_IDENTIFIER)), *map(found, _LINKS), F.concat(*map(found, _QUOTED)), words, pairs]
    canon = F.concat_ws("\0\0", *[F.array_join(F.array_sort(F.array_distinct(g)), "\0") for g in groups])
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "0" * 16).otherwise(F.substring(F.sha2(canon, 256), 1, 16))


def _sql_topic() -> str:
    t = f"nfc_normalize(substr({{0}}, 1, {TOPIC_CHARS}))"
    quoted = lambda p: p.replace("{", "{{").replace("}", "}}")
    found = lambda p, of=t: f"regexp_extract_all({of}, {quoted(sql_text(p))}, 1)"
    words = f"list_filter({found(_TOPIC_WORD, f'lower({t})')}, lambda w: NOT list_contains({sql_list(fixed.TOPIC_STOP_WORDS)}, w))"
    pairs = f"(SELECT list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) FROM (SELECT {words} AS w))"
    groups = [f"list_filter({found(_WORD_RUN)}, lambda w: regexp_matches(w, {quoted(sql_text(_IDENTIFIER))}))", *map(found, _LINKS), f"list_concat({', '.join(map(found, _QUOTED))})", words, pairs]
    canon = " || chr(0) || chr(0) || ".join(f"coalesce(array_to_string(list_sort(list_distinct({g})), chr(0)), '')" for g in groups)
    return f"CASE WHEN coalesce({{0}}, '') = '' THEN '{'0' * 16}' ELSE substr(sha256({canon}), 1, 16) END"


SQL_TOPIC = _sql_topic()


@query("E15_topic_signature", f"SELECT session_id, turn, {SQL_TOPIC.format('content')} AS signature FROM turns")
def e15_topic_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.turns(spark, sf_dir).select("session_id", "turn", topic_signature(F.col("content")).alias("signature"))


@query(
    "E16_low_quality_filter",
    r"""WITH k AS (SELECT fact_id, substr(regexp_replace(lower(trim(content, ' ')), '[ \t\n\r\f]+', ' ', 'g'), 1, 200) AS key FROM facts WHERE trim(content, ' ') <> '' AND NOT regexp_matches(content, '^(<[^>]*>)+$'))
    SELECT min(fact_id) AS fact_id, count(*) AS copies FROM k GROUP BY key""",
)
def e16_low_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are not empty and not tags only, one for each beginning of 200 characters."""
    text = views.facts(spark, sf_dir).where((F.trim("content") != "") & ~F.col("content").rlike(r"^(<[^>]*>)+$"))
    key = F.substring(F.regexp_replace(F.lower(F.trim("content")), r"[ \t\n\r\f]+", " "), 1, 200)
    return text.groupBy(key.alias("key")).agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("copies")).drop("key")


ACKNOWLEDGEMENTS = ["ok", "okay", "yes", "no", "thanks", "thank you", "sure", "got it", "great", "cool"]


@query("E17_entropy_gate_static", f"SELECT session_id, turn, length(trim(content, ' ')) >= 10 AND NOT list_contains({sql_list(ACKNOWLEDGEMENTS)}, lower(trim(content, ' '))) AS passes FROM turns")
def e17_entropy_gate_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim("content")
    return views.turns(spark, sf_dir).select("session_id", "turn", ((F.length(text) >= 10) & ~F.lower(text).isin(ACKNOWLEDGEMENTS)).alias("passes"))


def _hits(text: Column, phrases: list[str]) -> Column:
    return sum((text.rlike(phrase_pattern([p])).cast("int") for p in phrases), F.lit(0))


def _sql_hits(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {sql_text(phrase_pattern([p]))})::INT" for p in phrases) + ")"


@query(
    "E18_classify_activity",
    "WITH h AS (SELECT fact_id, "
    + ", ".join(f"{_sql_hits('content', p)} AS {a}" for a, p in fixed.ACTIVITIES.items())
    + " FROM facts) SELECT fact_id, CASE WHEN greatest("
    + ", ".join(fixed.ACTIVITIES)
    + ") = 0 THEN 'other' "
    + " ".join(f"WHEN {a} = greatest({', '.join(fixed.ACTIVITIES)}) THEN '{a}'" for a in fixed.ACTIVITIES)
    + " END AS activity FROM h",
)
def e18_classify_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity with most keywords in the text; of equals the first."""
    counted = views.facts(spark, sf_dir).select("fact_id", *[_hits(F.col("content"), p).alias(a) for a, p in fixed.ACTIVITIES.items()])
    most = F.greatest(*fixed.ACTIVITIES)
    out = F.when(most == 0, "other")
    for a in fixed.ACTIVITIES:
        out = out.when(F.col(a) == most, a)
    return counted.select("fact_id", out.alias("activity"))


QUERY_CLASSES = [
    ("multi_hop", ["and then", "after that", "because", "as a result", "led to", "connection between", "relationship between"]),
    ("temporal", ["when", "date", "time", "year", "month", "ago", "before", "after", "during", "last", "next"]),
    ("aggregation", ["all", "list", "every", "everything", "various", "different", "many", "several", "multiple", "summarize", "overview"]),
    ("opinion", ["think", "feel", "opinion", "prefer", "favorite", "best", "worst", "believe", "dislike", "enjoy", "hate", "love"]),
    ("factual", ["who", "what", "where", "which", "how"]),
]


@query(
    "E24_extractive_summary",
    r"""WITH p AS (SELECT fact_id, session_id, string_split_regex(content, '[.!?\n]+') AS parts FROM facts),
    e AS (SELECT session_id, fact_id, trim(unnest(parts), ' ') AS sentence, generate_subscripts(parts, 1) AS pos FROM p),
    k AS (SELECT session_id, sentence, min((fact_id * 100000 + pos)::BIGINT) AS first FROM e WHERE length(sentence) >= 20 GROUP BY session_id, sentence)
    SELECT session_id, md5(substr(session_id || ': ' || string_agg(sentence, '. ' ORDER BY first), 1, 2000)) AS summary_md5, count(*) AS sentences FROM k GROUP BY session_id""",
)
def e24_extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct sentences of a session in order of first use, 2,000 characters at most.

    Only as many sentences are gathered for a session as can show in its summary: the first by a running length.
    """
    facts = views.facts(spark, sf_dir)
    each = sentences(facts).join(facts.select("fact_id", "session_id"), "fact_id")
    first = each.groupBy("session_id", "sentence").agg(F.min(F.col("fact_id") * 100000 + F.col("position") + 1).alias("first"))
    order = W.partitionBy("session_id").orderBy("first")
    shown = first.withColumn("before", F.coalesce(F.sum(F.length("sentence") + 2).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    part = F.when(F.col("before") < 2100, F.struct("first", "sentence"))
    got = shown.groupBy("session_id").agg(F.array_sort(F.collect_list(part)).alias("s"), F.count("*").alias("sentences"))
    text = F.concat(F.col("session_id"), F.lit(": "), F.array_join(F.transform("s", lambda x: x["sentence"]), ". "))
    return got.select("session_id", F.md5(F.substring(text, 1, 2000)).alias("summary_md5"), "sentences")


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(fixed.STOP_WORDS)))


@query(
    "E25_topic_shift",
    f"""WITH w AS (SELECT session_id, turn, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains({sql_list(fixed.STOP_WORDS)}, w))) AS w FROM turns),
    p AS (SELECT *, array_agg(w) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior FROM w)
    SELECT session_id, turn, coalesce(len(w) >= 5 AND len(prior) >= 2 AND list_max(list_transform(prior, lambda x: len(list_intersect(x, w)))) = 0, false) AS shift FROM p""",
)
def e25_topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of five content words or more that shares none with any of the five turns before it."""
    w = views.turns(spark, sf_dir).select("session_id", "turn", content_words(F.col("content")).alias("w"))
    prior = F.collect_list("w").over(W.partitionBy("session_id").orderBy("turn").rowsBetween(-5, -1))
    overlap = F.exists("prior", lambda x: F.arrays_overlap(x, F.col("w")))
    shift = (F.size("w") >= 5) & (F.size("prior") >= 2) & ~overlap
    return w.withColumn("prior", prior).select("session_id", "turn", F.coalesce(shift, F.lit(False)).alias("shift"))


CAPTURE = [("decision", ["decided", "decision", "we will", "agreed", "chose"]), ("bug", ["bug", "error", "fix", "broken", "issue"]), ("preference", ["prefer", "like", "love", "always", "never"])]


@query(
    "E27_capture_class",
    "SELECT session_id, turn, CASE WHEN length(content) < 20 THEN 'none' "
    + " ".join(f"WHEN {_sql_hits('content', p)} > 0 THEN '{n}'" for n, p in CAPTURE)
    + " ELSE 'none' END AS capture, (CASE WHEN length(content) < 20 THEN 0 "
    + " ".join(f"WHEN {_sql_hits('content', p)} > 0 THEN least(1.0, 0.5 + 0.25 * {_sql_hits('content', p)})" for n, p in CAPTURE)
    + " ELSE 0 END)::DOUBLE AS score FROM turns",
)
def e27_capture_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("content")
    kind, score = F.when(F.length(text) < 20, "none"), F.when(F.length(text) < 20, 0.0)
    for name, phrases in CAPTURE:
        n = _hits(text, phrases)
        kind, score = kind.when(n > 0, name), score.when(n > 0, F.least(F.lit(1.0), 0.5 + 0.25 * n))
    return views.turns(spark, sf_dir).select("session_id", "turn", kind.otherwise("none").alias("capture"), score.otherwise(0.0).alias("score"))
