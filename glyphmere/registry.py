"""Registered queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmere.functions import normalize as N
from glyphmere.functions import strings as S
from glyphmere.functions import verdict as V
from glyphmere.functions.tables import merged_tables
from glyphmere.operators import evaluate as E
from glyphmere.plans.pairs import Config, score, similarity_join, watchlist
from glyphmere.sources.readers import split_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---- inputs, in both languages


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(spark, d) -> DataFrame:
    """Each part's name with that of the next part."""
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("a", "b").distinct()


_PAIRS = "pairs AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


def _looks(spark, d) -> DataFrame:
    """Each part's name with one in which l, o, m are look-alikes of them."""
    return _t(spark, d, "part").select(F.col("p_name").alias("a"), F.replace(F.translate("p_name", "lo", "10"), F.lit("m"), F.lit("rn")).alias("b")).distinct()


_LOOKS = "pairs AS (SELECT DISTINCT p_name AS a, replace(translate(p_name, 'lo', '10'), 'm', 'rn') AS b FROM part)"


def _labels(spark, d) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return _t(spark, d, "pages").select(F.split_part(host, F.lit("."), F.lit(1)).alias("label")).distinct()


_LABELS = "labels_ AS (SELECT DISTINCT split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1) AS label FROM pages)"


def _tokens(spark, d) -> DataFrame:
    """Distinct ASCII words of the documents, of 3 letters or more."""
    return _t(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).where("length(value) >= 3").distinct()


_TOKENS = "tokens AS (SELECT DISTINCT value FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS value FROM documents) WHERE length(value) >= 3)"


def _variants(spark, d) -> DataFrame:
    """Part names as package names in three spellings."""
    k = F.col("p_partkey") % 3
    spelt = F.when(k == 0, F.translate("p_name", " ", "_")).when(k == 1, F.initcap(F.translate("p_name", " ", "."))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-._--")))
    return _t(spark, d, "part").select(spelt.alias("name"), F.translate("p_name", " ", "-").alias("plain")).distinct()


_VARIANTS = """variants AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN translate(p_name, ' ', '_')
  WHEN 1 THEN upper(p_name[1]) || lower(replace(p_name[2:], ' ', '.')) ELSE replace(p_name, ' ', '-._--') END AS name, translate(p_name, ' ', '-') AS plain FROM part)"""


def _osa(src: str, x: str = "a", y: str = "b", name: str = "osa") -> str:
    """CTEs that give ``name`` (x, y, d): restricted Damerau distances of the pairs of ``src``, a row of the matrix a step."""
    return f"""{name}_in AS (SELECT DISTINCT {x} AS x, {y} AS y FROM {src}),
{name}_r AS (
  SELECT x, y, string_split(x, '') AS cx, string_split(y, '') AS cy, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS p2, range(0, length(y) + 1) AS p1 FROM {name}_in
  UNION ALL
  SELECT x, y, cx, cy, i + 1, p1, [j + list_min([cand[k + 1] - k for k in range(0, j + 1)]) for j in range(0, length(y) + 1)]
  FROM (SELECT *, [CASE WHEN j = 0 THEN i + 1 ELSE least(p1[j + 1] + 1, p1[j] + CASE WHEN cx[i + 1] = cy[j] THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND j >= 2 AND cx[i + 1] = cy[j - 1] AND cx[i] = cy[j] THEN p2[j - 1] + 1 ELSE 1000000 END) END for j in range(0, length(y) + 1)] AS cand FROM {name}_r WHERE i < length(x))
),
{name} AS (SELECT x, y, p1[length(y) + 1] AS d FROM {name}_r WHERE i = length(x))"""


def _sk(s: str) -> str:
    return f"replace(replace(replace(translate({s}, '01I`|', 'Oll''l'), 'm', 'rn'), '\"', ''''''), '%', 'º/₀')"


def _combo(a: str, b: str) -> str:
    short, long = f"(CASE WHEN length({a}) <= length({b}) THEN lower({a}) ELSE lower({b}) END)", f"(CASE WHEN length({a}) <= length({b}) THEN lower({b}) ELSE lower({a}) END)"
    ends = " OR ".join(f"starts_with({long}, {short} || '{c}') OR ends_with({long}, '{c}' || {short})" for c in "-_./")
    return f"(lower({a}) <> lower({b}) AND length({short}) >= 3 AND ({ends} OR list_contains(string_split_regex({long}, '[-_./]'), {short})))"


def _class(a: str, b: str, d: str, skeletons: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 'identical' WHEN ({skeletons} OR {d} <= 1) AND greatest(length({a}), length({b})) >= 3 THEN 'likely_typosquat' WHEN {_combo(a, b)} THEN 'possible_combosquat' ELSE 'unrelated' END"


# ---- axes


@query(f"WITH {_PAIRS} SELECT a, b, a = b AS equal, CAST(levenshtein(a, b) AS BIGINT) AS levenshtein FROM pairs")
def equal_levenshtein(spark, d):
    return score(_pairs(spark, d), cfg=Config(fields="equal,levenshtein"))


@query(f"WITH RECURSIVE {_PAIRS}, {_osa('pairs')} SELECT a, b, d AS damerau FROM pairs JOIN osa ON a = x AND b = y")
def damerau_osa(spark, d):
    return score(_pairs(spark, d), cfg=Config(fields="damerau"))


@query(f"SELECT DISTINCT name, {_sk('name')} AS skeleton, CAST(length({_sk('name')}) AS BIGINT) AS skeleton_len FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)")
def skeleton_ascii(spark, d):
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).union(_t(spark, d, "customer").select("c_name")).union(_t(spark, d, "supplier").select("s_name")).distinct()
    return names.withColumn("skeleton", S.skeleton(F.col("name"))).withColumn("skeleton_len", F.length("skeleton").cast("long"))


@query(f"WITH RECURSIVE {_PAIRS}, sk AS (SELECT a, b, {_sk('a')} AS p, {_sk('b')} AS q FROM pairs), {_osa('sk', 'p', 'q')} SELECT a, b, CAST(levenshtein(p, q) AS BIGINT) AS skeleton_levenshtein, d AS skeleton_damerau FROM sk JOIN osa ON p = x AND q = y")
def skeleton_distances(spark, d):
    return score(_pairs(spark, d), cfg=Config(fields="skeleton_levenshtein,skeleton_damerau"))


@query(f"""WITH RECURSIVE {_LOOKS}, sk AS (SELECT a, b, {_sk('a')} AS p, {_sk('b')} AS q FROM pairs), {_osa('sk', 'p', 'q', 'skd')}, {_osa('pairs')}
SELECT a, b, osa.d AS damerau, greatest(osa.d - skd.d, 0) AS uts39_skeleton_delta, a <> b AND p = q AS confusable_only FROM sk JOIN osa ON a = osa.x AND b = osa.y JOIN skd ON p = skd.x AND q = skd.y""")
def skeleton_delta(spark, d):
    return score(_looks(spark, d), cfg=Config(fields="damerau,uts39_skeleton_delta,confusable_only"))


@query("""WITH keys AS (SELECT unnest(string_split('1234567890-=', '')) AS k, generate_subscripts(string_split('1234567890-=', ''), 1) - 1.0 AS kx, 0.0 AS ky
 UNION ALL SELECT unnest(string_split('qwertyuiop[]', '')), generate_subscripts(string_split('qwertyuiop[]', ''), 1) - 0.5, 1.0
 UNION ALL SELECT unnest(string_split('asdfghjkl;''', '')), generate_subscripts(string_split('asdfghjkl;''', ''), 1) - 0.25, 2.0
 UNION ALL SELECT unnest(string_split('zxcvbnm,./', '')), generate_subscripts(string_split('zxcvbnm,./', ''), 1) + 0.25, 3.0),
pairs AS (SELECT DISTINCT p_name AS a, chr(ascii(p_name) + 1) || p_name[2:] AS b FROM part)
SELECT a, b, CAST(0 AS BIGINT) AS uts39_confusable_count, round(coalesce(sqrt((u.kx - v.kx) * (u.kx - v.kx) + (u.ky - v.ky) * (u.ky - v.ky)) / 11.543396, 0), 5) AS keyboard_distance
FROM pairs LEFT JOIN keys u ON lower(a[1]) = u.k LEFT JOIN keys v ON lower(b[1]) = v.k""")
def keyboard_distance(spark, d):
    b = F.concat(F.char(F.ascii("p_name") + 1), F.expr("substring(p_name, 2)"))
    pairs = _t(spark, d, "part").select(F.col("p_name").alias("a"), b.alias("b")).distinct()
    out = score(pairs, cfg=Config(fields="uts39_confusable_count,keyboard_distance"))
    return out.withColumn("keyboard_distance", F.round("keyboard_distance", 5))


@query("""SELECT DISTINCT p_name AS a, translate(p_name, 'lo', '10') AS b, CAST(length(p_name) - length(translate(p_name, 'l', '')) AS BIGINT) AS uts39_confusable_count FROM part""")
def confusable_count(spark, d):
    """l and 1 look alike, o and 0 don't."""
    pairs = _t(spark, d, "part").select(F.col("p_name").alias("a"), F.translate("p_name", "lo", "10").alias("b")).distinct()
    return score(pairs, cfg=Config(fields="uts39_confusable_count"))


@query("""WITH pairs AS (SELECT DISTINCT p_name AS a, translate(p_name, 'ae', 'qw') AS b, length(p_name) - length(translate(p_name, 'a', '')) AS n, length(p_name) - length(translate(p_name, 'e', '')) AS m FROM part)
SELECT a, b, round(CASE WHEN n + m = 0 THEN 0 ELSE (n * sqrt(0.0625 + 1) + m) / (n + m) / 11.543396 END, 5) AS keyboard_distance FROM pairs""")
def keyboard_distance_mean(spark, d):
    """Several substitutions in a name: the mean of their distances."""
    pairs = _t(spark, d, "part").select(F.col("p_name").alias("a"), F.translate("p_name", "ae", "qw").alias("b")).distinct()
    return score(pairs, cfg=Config(fields="keyboard_distance")).withColumn("keyboard_distance", F.round("keyboard_distance", 5))


_OTHER = "translate(replace(replace(p_name, 'b', '\u00e7'), 'd', '\uf900'), 'aeopcxgh', '\u0430\u0435\u043e\u0440\u0441\u0445\u011b\u2126')"


@query(f"""WITH n AS (SELECT DISTINCT {_OTHER} AS name FROM part)
SELECT name, {_sk("replace(translate(name, '\u0430\u0435\u043e\u0440\u0441\u0445\u011b\u2126\uf900', 'aeopcx\u0115\u03a9\u8c48'), '\u00e7', 'c\u0326')")} AS skeleton FROM n""")
def skeleton_other(spark, d):
    """Skeletons of names with look-alikes beyond ASCII, composed letters and characters that stand for others."""
    return _t(spark, d, "part").select(F.expr(_OTHER).alias("name")).distinct().withColumn("skeleton", S.skeleton(F.col("name")))


@query("""SELECT DISTINCT a, b, CAST(CASE WHEN a = b THEN 0 WHEN regexp_matches(a, '[bdf-npq-z]') AND regexp_matches(a, '[aeopc]') AND regexp_matches(b, '[a-zA-Z]') THEN 4 ELSE 1 END AS BIGINT) AS script_restriction
FROM (SELECT replace(p_name, ' ', '-') AS a, translate(replace(p_name, ' ', '-'), 'aeopc', 'аеорс') AS b FROM part)""")
def script_restriction(spark, d):
    a = F.replace("p_name", F.lit(" "), F.lit("-"))
    pairs = _t(spark, d, "part").select(a.alias("a"), F.translate(a, "aeopc", "аеорс").alias("b")).distinct()
    return score(pairs, cfg=Config(fields="script_restriction"))


@query(f"WITH {_PAIRS} SELECT a, b, a = b AS equal, CAST(levenshtein({_sk('a')}, {_sk('b')}) AS BIGINT) AS skeleton_levenshtein FROM pairs")
def fields_projection(spark, d):
    return score(_pairs(spark, d), cfg=Config(fields="skeleton_levenshtein, equal,equal"))


# ---- rules and gates


@query(f"WITH {_VARIANTS} SELECT name, regexp_replace(translate(lower(name), '._-', '---'), '-+', '-', 'g') AS normalized FROM variants")
def normalize_pypi(spark, d):
    return _variants(spark, d).select("name", N.normalized(F.col("name"), N.PYPI).alias("normalized"))


@query(f"WITH {_VARIANTS} SELECT name, regexp_replace(replace(replace(name, '.', ''), '_', ':'), '-+', '-', 'g') AS normalized FROM variants")
def normalize_rules(spark, d):
    ops = N.parse_rules('[["map", ".", ""], ["map", "_", ":"], ["collapse", "-"]]')
    return _variants(spark, d).select("name", N.normalized(F.col("name"), ops).alias("normalized"))


@query(f"""WITH RECURSIVE {_VARIANTS}, n AS (SELECT name AS a, plain AS b, regexp_replace(translate(lower(name), '._-', '---'), '-+', '-', 'g') AS na, regexp_replace(translate(lower(plain), '._-', '---'), '-+', '-', 'g') AS nb FROM variants),
s AS (SELECT *, CASE WHEN a = b OR na = nb THEN a ELSE na END AS p, CASE WHEN a = b OR na = nb THEN b ELSE nb END AS q FROM n), {_osa('s', 'p', 'q')}
SELECT a, b, na AS a_normalized, nb AS b_normalized, p = q AS equal, d AS damerau FROM s JOIN osa ON p = x AND q = y""")
def identity_gate(spark, d):
    return score(_variants(spark, d).select(F.col("name").alias("a"), F.col("plain").alias("b")), cfg=Config(fields="equal,damerau", norm_ops=N.PYPI))


_HOSTS = "hosts AS (SELECT DISTINCT split_part(h, '.', 1) AS a, h AS b FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages) UNION SELECT p_name, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '-x' END FROM part)"


def _hosts(spark, d) -> DataFrame:
    h = _t(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("h"))
    p = _t(spark, d, "part").select("p_name", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("-x")))
    return h.select(F.split_part("h", F.lit("."), F.lit(1)).alias("a"), F.col("h").alias("b")).union(p).distinct()


@query(f"WITH {_HOSTS} SELECT a, b, {_combo('a', 'b')} AS combosquat FROM hosts")
def combosquat(spark, d):
    return _hosts(spark, d).select("a", "b", S.is_combosquat(F.col("a"), F.col("b")).alias("combosquat"))


# ---- classes and verdicts


@query(f"WITH RECURSIVE src AS (SELECT * FROM (WITH {_HOSTS} SELECT * FROM hosts) UNION SELECT * FROM (WITH {_LOOKS} SELECT * FROM pairs)), {_osa('src')} SELECT a, b, {_class('a', 'b', 'd', _sk('a') + ' = ' + _sk('b'))} AS classification FROM src JOIN osa ON a = x AND b = y")
def typosquat_class(spark, d):
    src = _hosts(spark, d).union(_looks(spark, d)).distinct()
    out = score(src, cfg=Config(fields="damerau,confusable_only,keyboard_distance"))
    label, _ = V.classified(F.col("a") == F.col("b"), F.lit(False), F.col("a"), F.col("b"), F.col("damerau"), F.col("confusable_only"), F.col("keyboard_distance"))
    return out.select("a", "b", label.alias("classification"))


@query(f"WITH RECURSIVE {_LABELS}, src AS (SELECT x.label AS a, y.label AS b FROM labels_ x, labels_ y), {_osa('src')}, c AS (SELECT a, b, d, {_class('a', 'b', 'd', _sk('a') + ' = ' + _sk('b'))} AS classification FROM src JOIN osa ON a = x AND b = y) SELECT a AS input, b AS match, d AS damerau, classification FROM c WHERE classification IN ('likely_typosquat', 'possible_combosquat')")
def typosquat_alerts(spark, d):
    names = _labels(spark, d)
    out = similarity_join(names.select(F.col("label").alias("input")), names.select(F.col("label").alias("match")), Config(typosquat=True, fields="damerau"))
    return out.select("input", "match", "damerau", "classification")


@query(f"""WITH RECURSIVE src AS (SELECT * FROM (WITH {_PAIRS} SELECT * FROM pairs) UNION SELECT * FROM (WITH {_LOOKS} SELECT * FROM pairs)), sk AS (SELECT a, b, {_sk('a')} AS p, {_sk('b')} AS q FROM src), {_osa('sk', 'p', 'q', 'skd')}, {_osa('src')},
v AS (SELECT a, b, osa.d AS d, skd.d AS s, a <> b AND p = q AS only_ FROM sk JOIN osa ON a = osa.x AND b = osa.y JOIN skd ON p = skd.x AND q = skd.y)
SELECT a, b, CASE WHEN a = b THEN 'IDENTICAL' WHEN only_ OR (d > 0 AND greatest(d - s, 0) / d > 0.5 AND greatest(length(a), length(b)) >= 3 AND abs(length(a) - length(b)) / greatest(length(a), length(b), 1) <= 0.25) THEN 'LIKELY SPOOF' ELSE 'LIKELY BENIGN' END AS verdict FROM v""")
def spoof_verdict(spark, d):
    out = score(_pairs(spark, d).union(_looks(spark, d)).distinct(), cfg=Config(fields="equal,damerau,skeleton_damerau,uts39_skeleton_delta,confusable_only"))
    label, _ = V.verdict(*(F.col(c) for c in ("a", "b", "equal", "damerau", "skeleton_damerau", "uts39_skeleton_delta", "confusable_only")))
    return out.select("a", "b", label.alias("verdict"))


# ---- lists and joins


@query(f"WITH {_TOKENS} SELECT 'thing' AS input, value AS match, CAST(levenshtein('thing', value) AS BIGINT) AS levenshtein FROM tokens WHERE levenshtein('thing', value) <= 2")
def watchlist_threshold(spark, d):
    return watchlist(_tokens(spark, d), "thing", Config(fields="levenshtein", metric="levenshtein", threshold=2.0), ord_col="value_")


@query(f"WITH {_TOKENS} SELECT 'ention' AS input, value AS match, CAST(levenshtein('ention', value) AS BIGINT) AS levenshtein FROM tokens ORDER BY levenshtein, value LIMIT 25")
def watchlist_topn(spark, d):
    return watchlist(_tokens(spark, d).withColumn("ord", F.col("value")), "ention", Config(fields="levenshtein", metric="levenshtein", top=25))


@query(f"WITH {_TOKENS} SELECT 'lodash' AS input, value AS match, {_sk('value')} = {_sk(chr(39) + 'lodash' + chr(39))} AND value <> 'lodash' AS confusable_only FROM tokens WHERE levenshtein({_sk('value')}, 'lodash') <= 3")
def watchlist_skeleton(spark, d):
    return watchlist(_tokens(spark, d), "lodash", Config(fields="confusable_only", metric="skeleton_levenshtein", threshold=3.0))


@query("""SELECT 'pair' AS kind, split_part(l, s, 1) AS a, l[length(split_part(l, s, 1)) + 2:] AS b FROM (SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ',' ELSE chr(9) END || c_address || ',' || c_mktsegment AS l, CASE c_custkey % 3 WHEN 0 THEN ',' ELSE chr(9) END AS s FROM (SELECT *, 'addr' AS c_address FROM customer) WHERE c_custkey % 3 < 2)
UNION ALL SELECT 'malformed line', c_name, NULL FROM customer WHERE c_custkey % 3 = 2""")
def pair_split_malformed(spark, d):
    k = F.col("c_custkey") % 3
    line = F.when(k == 2, F.col("c_name")).otherwise(F.concat("c_name", F.when(k == 0, ",").otherwise("\t"), F.lit("addr,"), "c_mktsegment"))
    good, bad = split_pairs(_t(spark, d, "customer").select(line.alias("value")))
    return good.select(F.lit("pair").alias("kind"), "a", "b").union(bad.select("error", "line", F.lit(None).cast("string")))


def _near(spark, d, top=None):
    left = _labels(spark, d).select(F.col("label").alias("input"))
    return similarity_join(left, _tokens(spark, d).select(F.col("value").alias("match")), Config(fields="levenshtein", metric="levenshtein", threshold=1.0), top=top)


_NEAR = f"{_LABELS}, {_TOKENS}, near AS (SELECT label AS input, value AS match, CAST(levenshtein(label, value) AS BIGINT) AS levenshtein FROM labels_ JOIN tokens ON abs(length(label) - length(value)) <= 1 WHERE levenshtein(label, value) <= 1)"


@query(f"WITH {_NEAR} SELECT * FROM near")
def similarity_join_blocked(spark, d):
    return _near(spark, d)


@query(f"WITH {_NEAR} SELECT input, match, levenshtein FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY levenshtein, match) AS nth FROM near) WHERE nth <= 3")
def topn_per_query(spark, d):
    return _near(spark, d, top=3)


@query("""WITH base AS (SELECT ascii(n_name) AS cp, min(n_name) AS skeleton FROM nation GROUP BY 1), more AS (SELECT ascii(upper(p_name)) AS cp, min(p_name) AS skeleton FROM part GROUP BY 1)
SELECT cp, skeleton, 'uts39' AS source FROM base UNION ALL SELECT cp, skeleton, 'flowcrypt' FROM more WHERE cp NOT IN (SELECT cp FROM base)""")
def confusables_merge(spark, d):
    base = _t(spark, d, "nation").groupBy(F.ascii("n_name").alias("cp")).agg(F.min("n_name").alias("skeleton"))
    more = _t(spark, d, "part").groupBy(F.ascii(F.upper("p_name")).alias("cp")).agg(F.min("p_name").alias("skeleton"))
    return merged_tables(base, more)


# ---- evaluation


def _labelled(spark, d) -> DataFrame:
    """Synthetic squats of part names, with the technique."""
    n = _t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("match")).distinct()
    made = {"swap": "concat(substring(match, 2, 1), substring(match, 1, 1), substring(match, 3))", "double": "concat(substring(match, 1, 1), match)", "combo": "concat(match, '-dev')", "far": "concat('xyz', match)"}
    out = None
    for k, e in made.items():
        part = n.select(F.expr(e).alias("input"), "match", F.lit(k).alias("technique"))
        out = part if out is None else out.union(part)
    return out


_LABELLED = """n AS (SELECT DISTINCT replace(p_name, ' ', '') AS match FROM part), labelled AS (SELECT match[2] || match[1] || match[3:] AS input, match, 'swap' AS technique FROM n
 UNION ALL SELECT match[1] || match, match, 'double' FROM n UNION ALL SELECT match || '-dev', match, 'combo' FROM n UNION ALL SELECT 'xyz' || match, match, 'far' FROM n)"""
_HITS = f"{_LABELLED}, {_osa('labelled', 'input', 'match')}, c AS (SELECT input, match, technique, {_class('input', 'match', 'd', _sk('input') + ' = ' + _sk('match'))} AS classification FROM labelled JOIN osa ON input = x AND match = y), hits AS (SELECT * FROM c WHERE classification IN ('likely_typosquat', 'possible_combosquat'))"


def _hits(spark, d) -> DataFrame:
    return score(_labelled(spark, d), "input", "match", Config(typosquat=True), gate=True)


@query(f"WITH RECURSIVE {_HITS}, j AS (SELECT technique, CASE WHEN classification IN ('likely_typosquat', 'possible_combosquat') THEN 1 ELSE 0 END AS hit FROM c) SELECT coalesce(technique, 'TOTAL') AS technique, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, round(100 * sum(hit) / count(*), 1) AS pct FROM j GROUP BY ROLLUP (technique)")
def recall_by_class(spark, d):
    return E.recall(_labelled(spark, d), _hits(spark, d))


@query(f"WITH RECURSIVE {_HITS} SELECT input, match, technique FROM c WHERE classification NOT IN ('likely_typosquat', 'possible_combosquat')")
def missed_pairs(spark, d):
    return E.missed(_labelled(spark, d), _hits(spark, d)).select("input", "match", "technique")


_CHANGED = f"{_LABELLED}, every AS (SELECT input, match FROM labelled UNION SELECT translate(match[1], 'abcdefghijklmnopqrstuvwxyz', 'bcdefghijklmnopqrstuvwxyza') || match[2:], match FROM n UNION SELECT translate(match, 'lo', '10'), match FROM n)"


@query(f"""WITH RECURSIVE {_CHANGED}, {_osa('every', 'input', 'match')}
SELECT input, match, CASE WHEN input = match THEN 'The strings are identical.' WHEN {_sk('input')} = {_sk('match')} THEN 'Strings differ but share a confusable skeleton (visual lookalike).'
  WHEN d = 1 AND length(input) = length(match) AND len(list_filter(range(1, length(match) + 1), lambda i: input[i] <> match[i])) = 1 THEN '1 Damerau edit.' WHEN d <= 1 THEN '1 Damerau edit. Keyboard distance 0 (no far-key substitutions).'
  WHEN {_combo('input', 'match')} THEN 'One name is the other plus a delimited affix (possible combosquat).' ELSE 'No typosquat signal (damerau > 1 and not confusable-only).' END AS reason
FROM every JOIN osa ON input = x AND match = y""")
def typosquat_reason(spark, d):
    """Why pairs have their class: swaps, insertions, substitutions, look-alikes, affixes, others."""
    n = _t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("match")).distinct()
    next_letter = F.concat(F.translate(F.substring("match", 1, 1), "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza"), F.expr("substring(match, 2)"))
    pairs = _labelled(spark, d).select("input", "match").union(n.select(next_letter, "match")).union(n.select(F.translate("match", "lo", "10"), "match")).distinct()
    out = score(pairs, "input", "match", Config(fields="damerau,confusable_only,keyboard_distance"))
    _, reason = V.classified(F.col("input") == F.col("match"), F.lit(False), F.col("input"), F.col("match"), F.col("damerau"), F.col("confusable_only"), F.col("keyboard_distance"))
    return out.select("input", "match", reason.alias("reason"))


@query(f"WITH RECURSIVE {_HITS} SELECT classification, count(*) AS n FROM hits GROUP BY classification")
def class_histogram(spark, d):
    return E.histogram(_hits(spark, d))


@query(f"WITH RECURSIVE {_HITS} SELECT 'damerau 1' AS mode, count(*) AS n FROM labelled JOIN osa ON input = x AND match = y WHERE d <= 1 UNION ALL SELECT 'typosquat', count(*) FROM hits")
def emitted_rows(spark, d):
    near = score(_labelled(spark, d), "input", "match", Config(metric="damerau", threshold=1.0, fields=""), gate=True)
    return E.emitted({"typosquat": _hits(spark, d), "damerau 1": near})


@query("SELECT DISTINCT value FROM (SELECT p_name AS value FROM part UNION ALL SELECT c_name FROM customer)")
def haystack_distinct(spark, d):
    return E.haystack(_t(spark, d, "part").select(F.col("p_name").alias("value")), _t(spark, d, "customer").select(F.col("c_name").alias("value")))


@query()
def full_panel(spark, d):
    """All ten axes of names and their homoglyph forms; SQL has no general alignment."""
    pairs = _t(spark, d, "part").select(F.col("p_name").alias("a"), F.translate("p_name", "aeopc", "аеорс").alias("b")).union(_pairs(spark, d)).distinct()
    return score(pairs)


@query(f"""WITH RECURSIVE {_HITS} SELECT count(*) AS rows, CAST(CAST(coalesce(sum(CAST(('0x' || md5(input || chr(9) || match || chr(9) || technique || chr(9) || classification)[:15]) AS BIGINT)), 0) AS HUGEINT) AS VARCHAR) AS digest FROM hits""")
def result_digest(spark, d):
    hits = _hits(spark, d).select("input", "match", "classification").join(_labelled(spark, d), ["input", "match"])
    return E.digest(hits.select("input", "match", "technique", "classification"))
