"""Registered queries of the package, with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelpulse.llm import (
    bpe_automaton,
    embeddings,
    licenses,
    line_dedup,
    minhash,
    mixing,
    periodic,
    prefix_trie,
    quality_rules,
    resampling,
    secret_scan,
    token_counts,
    toxicity,
)
from modelpulse.llm.common import let, read, words_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BPE_FILE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode its ids; digests of both."""
    machine = bpe_automaton.compiled(spark, public_tokenizers.path(BPE_FILE))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_automaton.round_trip(docs, "text", machine).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(spark, docs, "text", public_tokenizers.path(BPE_FILE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op7_source_mix")
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents, each a member of its one source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    taken, sizes, targets = mixing.mix(docs, F.array("source"), F.col("size"))
    known = [(s, sizes[s], targets[s]) for s in sizes]
    table = spark.createDataFrame(known, "_source string, source_size bigint, target double")
    joined = taken.join(F.broadcast(table), F.expr("source <=> _source"))
    return joined.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document among texts whose 5-word shingles overlap by 0.8 or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_near_vectors")
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


LINES_SQL = """
WITH doc AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM doc),
ln AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM raw),
l AS (SELECT *, row_number() OVER w AS i, sum(words) OVER w AS upto FROM ln WHERE words > 0
      WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
fw AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 50
       AND b.upto - a.upto + a.words >= 50 GROUP BY ALL),
bw AS (SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.i > a.i - 50
       AND a.upto - b.upto + b.words >= 50 GROUP BY a.doc_id, a.i),
win AS (SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS content
        FROM (SELECT * FROM fw UNION SELECT * FROM bw) w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN s AND e GROUP BY ALL),
later AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS no FROM win),
gone AS (SELECT DISTINCT l.doc_id, l.place FROM later w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN s AND e WHERE no > 1),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.place) AS text FROM raw r
         ANTI JOIN gone g ON g.doc_id = r.doc_id AND g.place = r.place GROUP BY r.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n.n, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without runs of 50 words or more in whole lines that stand earlier too."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _rules_sql() -> str:
    checks = []
    for rule in quality_rules.RULES:
        held = [f"{rule.count} >= {rule.low!r} * {rule.of}"] if rule.low is not None else []
        held += [f"{rule.count} <= {rule.high!r} * {rule.of}"] if rule.high is not None else []
        checks.append(f"({rule.of} = 0 OR ({' AND '.join(held)}))")
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
t AS (SELECT doc_id, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o AS g FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM t WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: list_contains([{stop}], lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words,
        len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1))::BIGINT AS n_loud_words,
        len(lines)::BIGINT AS n_lines, 1 AS one,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]')))::BIGINT AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept FROM b
"""


@query("op4_quality_rules", _rules_sql())
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _licenses_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(
        f"({quoted(name)}, {no}, {quoted(text)})"
        for name, texts in sorted(licenses.TEMPLATES.items())
        for no, text in enumerate(texts)
    )
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    grams = (
        "CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END"
    )
    return f"""
WITH tpl(license, template, wording) AS (VALUES {rows}),
tw AS (SELECT license, template, {words('wording')} AS words FROM tpl),
tg AS (SELECT license, template, greatest(len(words) - 1, 1) AS size, unnest({grams}) AS gram FROM tw),
tc AS (SELECT license, template, size, gram, count(*) AS often FROM tg GROUP BY ALL),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
lw AS (SELECT doc_id, place, {words('line')} AS words FROM ln),
lg AS (SELECT doc_id, place, greatest(len(words) - 1, 1) AS n, unnest({grams}) AS gram FROM lw),
lc AS (SELECT doc_id, place, n, gram, count(*) AS here FROM lg GROUP BY ALL),
f AS (SELECT doc_id, place, license, template, 2.0::DOUBLE * sum(least(here, often)) / (n + size) AS dice FROM lc JOIN tc USING (gram)
      GROUP BY doc_id, place, license, template, n, size HAVING 2.0::DOUBLE * sum(least(here, often)) / (n + size) >= {licenses.LEAST}),
b AS (SELECT doc_id, arg_min(license, {{'d': -dice, 'l': license}}) AS license, max(dice) AS dice, count(DISTINCT place) AS n_notices,
      list_sort(list(DISTINCT license)) AS licenses FROM f GROUP BY doc_id)
SELECT d.doc_id, b.license, round(b.dice, 6) AS dice, coalesce(n_notices, 0) AS n_notices, array_to_string(coalesce(licenses, []), ',') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN b USING (doc_id)
"""


@query("op10_license_scan", _licenses_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model fitted on labelled documents that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.PREDICTED_FROM).cast("int").alias("predicted"),
    )


@query("op8_quality_resample")
def op8_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As large a share of the documents as is labelled good, drawn towards the good ones."""
    labels = read(spark, sf_dir, "labels").where("quality is not null")
    good = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, labels.where("quality = 1").select("doc_id"), good)


#: Unsigned CRC-32 of the digits of a number, for the checking SQL.
CRC32_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""


def crc32_sql(number: str) -> str:
    return f"xor({CRC32_SQL.format(number)}, 4294967295::BIGINT)"


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns, {crc32_sql('conv_id')} % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
      FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS total, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, total, depth, md5(to_json(turns[1:depth])) AS key,
             CASE WHEN depth > 0 THEN md5(to_json(turns[1:depth - 1])) END AS up,
             CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS size FROM p),
n AS (SELECT depth, key, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
      FROM k GROUP BY depth, key),
c AS (SELECT up, count(*) AS n FROM n GROUP BY up),
m AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.key),
s AS (SELECT k.key, sum((m.n_convs - 1) * m.size) AS saved, count(*) FILTER (WHERE m.n_children = 0) AS leaves
      FROM m JOIN k ON k.conv_id = m.conv_id AND k.depth <= m.depth GROUP BY k.key)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.key = m.key LEFT JOIN n u ON u.key = m.up
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, rebuilt so that they share the turns they begin with."""
    turns = prefix_trie.rebuilt_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(turns).drop(*prefix_trie.KEY)


def _secrets_sql() -> str:
    def found(name: str, pattern: str, group: int = 0) -> str:
        """Matches of a pattern with their places."""
        quoted = pattern.replace("'", "''")
        return f"""
{name}_m AS (SELECT doc_no, doc_id, unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(regexp_extract_all(text, '{quoted}', {group})) AS body,
    unnest(list_transform(string_split_regex(text, '{quoted}'), lambda x: length(x))[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS i
  FROM d WHERE regexp_matches(text, '{quoted}')),
{name} AS (SELECT doc_no, doc_id, body, (sum(gap + length(m)) OVER w - length(m))::BIGINT AS s, (sum(gap + length(m)) OVER w)::BIGINT AS e
  FROM {name}_m WINDOW w AS (PARTITION BY doc_no ORDER BY i))"""

    weights = ", ".join(str(secret_scan.weight(n)) for n in range(max(c.window for c in secret_scan.CHARSETS) + 1))
    parts = [found("assign", secret_scan.ASSIGN, 1), found("access", secret_scan.ACCESS), found("hex", secret_scan.HEX)]
    spans = [
        f"SELECT doc_no, s, 0 AS k, e, 'assign' AS kind FROM assign WHERE length(body) >= {secret_scan.ASSIGN_LEAST}",
        "SELECT doc_no, s, 1, e, 'access' FROM access",
        "SELECT doc_no, s, 2, e, 'hex' FROM hex",
    ]
    for no, c in enumerate(secret_scan.CHARSETS):
        n, w = c.kind, c.window
        harmless = " OR ".join(f"regexp_matches(body, '{p}')" for p in secret_scan.ALLOWED)
        parts.append(found(n, f"{c.pattern}{{{w},}}"))
        parts.append(f"""
{n}_w AS (SELECT *, unnest(range(length(body) - {w} + 1)) AS f FROM {n} WHERE NOT ({harmless})),
{n}_c AS (SELECT doc_no, s, f, unnest(string_split(body[f + 1:f + {w}], '')) AS ch FROM {n}_w),
{n}_n AS (SELECT doc_no, s, f, ch, count(*) AS n FROM {n}_c GROUP BY ALL),
{n}_h AS (SELECT doc_no, s, f FROM {n}_n GROUP BY ALL HAVING sum([{weights}][n + 1]) <= {secret_scan.most_weight(c)}),
{n}_g AS (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY doc_no, s ORDER BY f) <= {w} THEN 0 ELSE 1 END AS new FROM {n}_h),
{n}_i AS (SELECT *, sum(new) OVER (PARTITION BY doc_no, s ORDER BY f) AS island FROM {n}_g),
{n}_s AS (SELECT doc_no, s + min(f) AS s, {3 + no} AS k, s + max(f) + {w} AS e, '{n}' AS kind FROM {n}_i GROUP BY doc_no, s, island)""")
        spans.append(f"SELECT doc_no, s, k, e, kind FROM {n}_s")
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc_no, doc_id, coalesce(text, '') AS text FROM documents),{','.join(parts)},
a AS ({' UNION ALL '.join(spans)}),
t AS (SELECT *, kind || ':' || s || ':' || e AS shown FROM a),
g AS (SELECT doc_no, string_agg(shown, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(shown, ',' ORDER BY s, k) AS spans,
        count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex
      FROM t GROUP BY doc_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_no)
"""


@query("op12_secret_scan", _secrets_sql())
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in all documents: fixed forms and dense strings."""
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[secret_scan.count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


RUNS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             {crc32_sql('doc_id')} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
l AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM l),
x AS (SELECT doc_no, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
u AS (SELECT doc_no, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
e AS (SELECT a.doc_no, b.i - a.i AS q, a.i FROM u a JOIN u b ON a.doc_no = b.doc_no AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_no, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_no, q, min(i) AS s, count(*) + q AS length FROM s GROUP BY doc_no, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_no, s AS start, length, min(q) AS period FROM m GROUP BY doc_no, s, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY length::DOUBLE / period DESC, start, period) AS rank FROM r),
t AS (SELECT doc_no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_no),
k AS (SELECT doc_no, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT u.* FROM u WHERE NOT EXISTS (
        SELECT 1 FROM r WHERE r.doc_no = u.doc_no AND u.i >= r.start + r.period AND u.i < r.start + r.length)) GROUP BY doc_no)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN t USING (doc_no) LEFT JOIN b ON b.doc_no = x.doc_no AND b.rank = 1 LEFT JOIN k ON k.doc_no = x.doc_no
"""


def _with_cycles(doc_id: str, text: str) -> Column:
    """The text of every tenth document with its end wound round a period; both follow from the id."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def wound(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        body = lambda start, period: F.transform(
            F.slice(words, start.cast("int") + 1, F.size(words)),
            lambda w, i: F.element_at(words, (start + i % period + 1).cast("int")),
        )
        return let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda s: F.array_join(F.concat(F.slice(words, F.lit(1), s["a"].cast("int")), body(s["a"], s["p"])), " "),
        )

    cycled = let(words_of(text), lambda words: F.when(F.size(words) > 0, wound(words)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, cycled).otherwise(F.coalesce(F.col(text), F.lit("")))


@query("op13_periodic_runs", RUNS_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of them wound round a period."""
    docs = read(spark, sf_dir, "documents").select("doc_id", _with_cycles("doc_id", "text").alias("text"))
    found = periodic.periodic_runs(docs)
    shown = F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        "n_runs",
        *[best[n].alias(n) for n in ("start", "length", "period")],
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(shown, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
