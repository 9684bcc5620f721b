"""One query for each operator, over the driver's tables, and the SQL that gives the same rows.

Conversations stand for questions and their turns for answers. Eight of the embeddings
stand for fixed centroids; k-means itself has queries of its own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor import checkpoints
from candor.config import EXAM_SIZES, Config
from candor.functions import vector as V
from candor.functions.rng import uniform
from candor.functions.text import STOPWORDS, strip_id
from candor.operators import clustering as C
from candor.operators import keywords as K
from candor.operators import kmeans as B
from candor.operators import scoring as S
from candor.operators import truth as T
from candor.plans.discovery import discover
from candor.sources import corpus
from candor.sources.tables import chat_answers, document_answers, hashed_word_model, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FACTORS = 8
CONFIG = Config(clusters=FACTORS, top_k=3, sweeps=3, max_iter=2)


def r6(c: Column | str) -> Column:
    """Rounded to a millionth, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = chain(sql)
        return f

    return register


# SQL: named steps, of which a query takes those that it mentions -------------

STEPS: dict[str, str] = {
    "stop": "SELECT unnest([" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]) AS word",
    "ans": "SELECT conv_id AS question_id, turn AS owner_id, text AS raw_answer FROM conversations",
    "tok0": r"""SELECT question_id, owner_id, list_filter(regexp_split_to_array(translate(regexp_replace(raw_answer, '[!-/:-@\[-`{-~]', ' ', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM ans""",
    "tok": "SELECT question_id, owner_id, unnest(range(len(w))) AS pos, unnest(w) AS content FROM tok0",
    "model": """SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
        FROM (SELECT DISTINCT content AS word FROM tok) WHERE ('0x' || substr(md5(word), 9, 4))::BIGINT % 10 <> 0""",
    "vecs": "SELECT m.word, m.vec_id, e.embedding::DOUBLE[] AS vec FROM model m JOIN embeddings e ON m.vec_id = e.vec_id",
    "kw": "SELECT question_id, owner_id, pos, content FROM tok WHERE content NOT IN (SELECT word FROM stop) AND content IN (SELECT word FROM vecs)",
    "dw": "SELECT question_id, content, count(*) AS n FROM kw GROUP BY ALL",
    "cen": f"SELECT vec_id::INTEGER AS k, embedding::DOUBLE[] AS mu FROM embeddings WHERE vec_id < {FACTORS}",
    "near": "SELECT word, vec, arg_max(k, (dot, -k)) AS cluster FROM (SELECT word, vec, k, list_dot_product(vec, mu) AS dot FROM vecs, cen) GROUP BY word, vec",
    "est": "SELECT question_id, content, n, vec, cluster FROM dw JOIN near ON content = word",
    "kc": "SELECT kw.*, cluster FROM kw JOIN near ON content = word",
    "grid": f"SELECT question_id, owner_id, unnest(range({FACTORS}))::INTEGER AS factor FROM ans",
    "obs": """SELECT g.question_id, g.owner_id, g.factor, CASE WHEN s.cluster IS NULL THEN 0 ELSE 1 END AS obs
        FROM grid g LEFT JOIN (SELECT DISTINCT question_id, owner_id, cluster FROM kc) s
        ON g.question_id = s.question_id AND g.owner_id = s.owner_id AND g.factor = s.cluster""",
    "z0": """SELECT DISTINCT question_id, factor, CASE WHEN ('0x' || substr(md5('truth:init|' || question_id || '|' || factor), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5
        THEN 0 ELSE 1 END AS indicator FROM obs""",
}


def _u(key: str) -> str:
    """The uniform number of a key, an SQL string."""
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _counts(z: str, obs: str = "obs") -> str:
    cells = ", ".join(f"count_if(indicator = {i} AND obs = {o}) AS n{i}{o}" for i in (0, 1) for o in (0, 1))
    return f"SELECT owner_id, {cells} FROM {obs} JOIN {z} USING (question_id, factor) GROUP BY owner_id"


def _likelihood(z: str, c: str, obs: str = "obs") -> str:
    a = Config().alpha
    term = lambda i: f"ln((CASE WHEN obs = 1 THEN n{i}1 + {a[2 * i + 1]}::DOUBLE ELSE n{i}0 + {a[2 * i]}::DOUBLE END - CASE WHEN indicator = {i} THEN 1 ELSE 0 END) / ({a[2 * i] + a[2 * i + 1]}::DOUBLE + n{i}0 + n{i}1))"
    return f"SELECT question_id, factor, indicator, ln(10.0::DOUBLE) + sum({term(0)}) AS l0, ln(10.0::DOUBLE) + sum({term(1)}) AS l1 FROM {obs} JOIN {z} USING (question_id, factor) JOIN {c} USING (owner_id) GROUP BY question_id, factor, indicator"


SWEEPS_MOST = 20
for _k in range(SWEEPS_MOST):
    STEPS[f"c{_k}"] = _counts(f"z{_k}")
    STEPS[f"l{_k}"] = _likelihood(f"z{_k}", f"c{_k}")
    STEPS[f"z{_k + 1}"] = f"SELECT question_id, factor, CASE WHEN l0 > l1 THEN 0 ELSE 1 END AS indicator FROM l{_k}"
    for _p, _obs in (("", "obs"), ("p", "pobs")):
        _z = "z0" if _k == 0 else f"{_p}d{_k}"
        STEPS[f"{_p}dl{_k}"] = _likelihood(_z, f"{_p}dc{_k}", _obs)
        STEPS[f"{_p}dc{_k}"] = _counts(_z, _obs)
        _draw = _u(f"'truth:sweep|{_k}|' || question_id || '|' || factor")
        STEPS[f"{_p}d{_k + 1}"] = f"SELECT question_id, factor, CASE WHEN {_draw} < exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) THEN 0 ELSE 1 END AS indicator FROM {_p}dl{_k}"
STEPS |= {
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, owner_id) AS rank FROM sco) WHERE rank <= 3",
    "voc": "SELECT DISTINCT question_id, content FROM tok",
    "vsz": "SELECT question_id, count(*) AS n_words FROM voc GROUP BY question_id",
    "alp": """SELECT question_id, n_words, ceil((-32 - log2(0.5 - (1 - exp(-3.0::DOUBLE)) / 4) - log2(n_words::DOUBLE)) / log2(exp(-3.0::DOUBLE)))::INTEGER AS alpha FROM vsz""",
    "gam0": """SELECT question_id, content, alpha, ('0x' || substr(md5('truth:gamma|' || question_id || '|' || content), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM voc JOIN alp USING (question_id)""",
    "gam": """SELECT question_id, content, alpha, least(greatest(CASE WHEN u <= 0.5 - (1 - exp(-3.0::DOUBLE)) / 4 THEN -1 WHEN u <= 0.5 + (1 - exp(-3.0::DOUBLE)) / 4 THEN 0
        ELSE ceil(ln((1 - u) / (0.5 - (1 - exp(-3.0::DOUBLE)) / 4)) / ln(exp(-3.0::DOUBLE)))::INTEGER END + alpha, 0), 2 * alpha) AS n FROM gam0""",
    "dum": "SELECT question_id, -1::BIGINT AS owner_id, unnest(range(n)) AS pos, content FROM gam",
    "all_": "SELECT question_id, owner_id, pos, content FROM tok UNION ALL SELECT * FROM dum",
    "sums": "SELECT question_id, cluster AS k, dim, sum(n * x) AS value FROM (SELECT question_id, cluster, n, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM est) GROUP BY ALL",
    "lens": "SELECT question_id, k, sqrt(sum(value * value)) AS length, count(*) AS d FROM sums GROUP BY ALL",
    "newc": "SELECT question_id, k, list(CASE WHEN length < 1e-8 THEN value ELSE value / length END ORDER BY dim) AS mu FROM sums JOIN lens USING (question_id, k) GROUP BY question_id, k",
    "posw": "SELECT question_id, content, n, vec, row_number() OVER (PARTITION BY question_id ORDER BY content) - 1 AS pos FROM est",
    "mass0": "SELECT question_id, pos, n, min(abs(2 - 2 * list_dot_product(vec, mu))) AS least FROM posw, (SELECT * FROM cen WHERE k < 3) GROUP BY question_id, pos, n",
    "mass": "SELECT question_id, pos, n * least AS mass, sum(n * least) OVER (PARTITION BY question_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / nullif(sum(n * least) OVER (PARTITION BY question_id), 0) AS cdf FROM (SELECT question_id, pos, n, CASE WHEN least < 1e-6 THEN 0 ELSE least END AS least FROM mass0)",
    "qs": "SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS place FROM (SELECT DISTINCT question_id FROM ans)",
    "ex": "SELECT * FROM (VALUES " + ", ".join(f"({k + 1}, {sum(EXAM_SIZES[:k])}, {n})" for k, n in enumerate(EXAM_SIZES)) + ") AS t(exam_id, first_question, n_questions)",
    "exq": "SELECT exam_id, question_id, n_questions FROM qs JOIN ex ON place >= first_question AND place < first_question + n_questions",
    "lab": "SELECT doc_id % 100 AS question_id, doc_id // 100 AS owner_id, quality * 5.0::DOUBLE AS score FROM labels",
}
for _old, _new in (("", "2"), ("2", "3")):
    _est = f"est{_old}"
    STEPS[f"sums{_new}"] = f"SELECT question_id, cluster AS k, dim, sum(n * x) AS value FROM (SELECT question_id, cluster, n, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM {_est}) GROUP BY ALL"
    STEPS[f"lens{_new}"] = f"SELECT question_id, k, sqrt(sum(value * value)) AS length FROM sums{_new} GROUP BY ALL"
    STEPS[f"newc{_new}"] = f"SELECT question_id, k, list(CASE WHEN length < 1e-8 THEN value ELSE value / length END ORDER BY dim) AS mu FROM sums{_new} JOIN lens{_new} USING (question_id, k) GROUP BY question_id, k"
    STEPS[f"cen{_new}"] = f"SELECT g.question_id, g.k, coalesce(c.mu, list_transform(g.mu, lambda x: 0.0::DOUBLE)) AS mu FROM (SELECT question_id, cen.* FROM (SELECT DISTINCT question_id FROM est), cen) g LEFT JOIN newc{_new} c USING (question_id, k)"
    STEPS[f"est{_new}"] = f"SELECT question_id, content, n, vec, arg_max(k, (list_dot_product(vec, c.mu), -k)) AS cluster FROM est JOIN cen{_new} c USING (question_id) GROUP BY question_id, content, n, vec"


for _p, _z in (("", "z3"), ("p", "pd3"), ("f", f"fz{Config().sweeps}")):
    STEPS[f"{_p}cnt"] = f"""SELECT a.question_id, a.owner_id, count(z.factor) AS n_true FROM ans a LEFT JOIN {_p}kc ON a.question_id = {_p}kc.question_id AND a.owner_id = {_p}kc.owner_id
        LEFT JOIN (SELECT * FROM {_z} WHERE indicator = 1) z ON {_p}kc.question_id = z.question_id AND {_p}kc.cluster = z.factor GROUP BY ALL"""
    STEPS[f"{_p}sco"] = f"SELECT question_id, owner_id, CASE WHEN sum(n_true) OVER q > 0 THEN n_true / (sum(n_true) OVER q)::DOUBLE ELSE n_true::DOUBLE END AS score FROM {_p}cnt WINDOW q AS (PARTITION BY question_id)"
# k-means++ and k-means|| with steps of k-means, over all words (p) and with odd owners as dummies (w)
STEPS["pd"] = "SELECT question_id, content, n FROM dw"
STEPS["wd"] = "SELECT question_id, content, count_if(owner_id % 2 = 0) AS n FROM kw GROUP BY ALL"
STEPS["rep"] = "SELECT word, vec, min(word) OVER (PARTITION BY vec) AS rep FROM vecs"
_FAR = "CASE WHEN abs(2 - 2 * list_dot_product(v.vec, c.{mu})) < 1e-6 THEN 0 ELSE abs(2 - 2 * list_dot_product(v.vec, c.{mu})) END"
STEPS_MOST = 30  # of k-means in SQL: more than any question needs to stand still


def _seeding(name: str, table: str, seed: str, clusters: int = FACTORS) -> None:
    """Seeds from the rows of a table (question_id, content, n, vec) by k-means++, as the step name + "c" + (clusters - 1)."""
    for k in range(clusters):
        if k == 0:
            STEPS[f"{name}m0"] = f"SELECT question_id, content, n::DOUBLE AS mass FROM {table}"
        else:
            STEPS[f"{name}m{k}"] = f"SELECT question_id, content, n * min({_FAR.format(mu='mu')}) AS mass FROM {table} v JOIN {name}c{k - 1} c USING (question_id) GROUP BY question_id, content, n"
        key = f"'{seed}|' || question_id || '|{k}|' || content"
        STEPS[f"{name}i{k}"] = f"""SELECT question_id, coalesce(arg_min(content, time) FILTER (WHERE time IS NOT NULL), max(content)) AS content FROM
            (SELECT question_id, content, -ln(1 - {_u(key)}) / nullif(mass, 0) AS time FROM {name}m{k}) GROUP BY question_id"""
        STEPS[f"{name}c{k}"] = (f"SELECT * FROM {name}c{k - 1} UNION ALL " if k else "") + f"SELECT question_id, {k} AS k, vec AS mu FROM {table} JOIN {name}i{k} USING (question_id, content)"


def _moving(name: str, table: str, start: str, steps: int) -> None:
    """Labels (name + "e" + step) and centers (name + "g" + step) of k-means over a table from the centers of a step."""
    STEPS[f"{name}g0"] = f"SELECT * FROM {start}"
    for k in range(steps + 1):
        STEPS[f"{name}e{k}"] = f"SELECT question_id, content, n, vec, arg_max(k, (list_dot_product(vec, c.mu), -k)) AS cluster FROM {table} JOIN {name}g{k} c USING (question_id) GROUP BY question_id, content, n, vec"
        STEPS[f"{name}t{k}"] = f"SELECT question_id, cluster AS k, dim, sum(n * x) AS value FROM (SELECT question_id, cluster, n, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM {name}e{k}) GROUP BY ALL"
        STEPS[f"{name}l{k}"] = f"SELECT question_id, k, sqrt(sum(value * value)) AS length FROM {name}t{k} GROUP BY ALL"
        STEPS[f"{name}n{k}"] = f"SELECT question_id, k, list(CASE WHEN length < 1e-8 THEN value ELSE value / length END ORDER BY dim) AS mu FROM {name}t{k} JOIN {name}l{k} USING (question_id, k) GROUP BY question_id, k"
        STEPS[f"{name}g{k + 1}"] = f"SELECT g.question_id, g.k, coalesce(c.mu, list_transform(g.mu, lambda x: 0.0::DOUBLE)) AS mu FROM {name}g{k} g LEFT JOIN {name}n{k} c USING (question_id, k)"


for _p in "pw":
    STEPS[f"{_p}w"] = f"SELECT question_id, content, n, vec FROM {_p}d JOIN vecs ON content = word"
    _seeding(_p, f"{_p}w", "truth:kmeans")
    STEPS[f"{_p}v"] = f"SELECT question_id, rep AS content, sum(n)::BIGINT AS n, any_value(vec) AS vec FROM {_p}d JOIN rep ON content = word GROUP BY question_id, rep"
# equal vectors as one, then k-means||; f: all words, with as many clusters as by default
for _p, _v, _n in (("p", "p", FACTORS), ("w", "w", FACTORS), ("f", "p", Config().clusters)):
    _first = _u("'truth:kmeans|' || question_id || '|first|' || content")
    STEPS[f"{_p}k0"] = f"""SELECT question_id, content, vec FROM {_v}v JOIN (SELECT question_id, arg_min(content, (time IS NULL, coalesce(time, 0), content)) AS content FROM
        (SELECT question_id, content, -ln(1 - {_first}) / nullif(n::DOUBLE, 0) AS time FROM {_v}v) GROUP BY question_id) USING (question_id, content)"""
    for _k in range(B.ROUNDS):
        _draw = _u(f"'truth:kmeans:round|' || question_id || '|{_k}|' || content")
        STEPS[f"{_p}j{_k}"] = f"SELECT question_id, v.content AS content, n * min({_FAR.format(mu='vec')}) AS mass FROM {_v}v v JOIN {_p}k{_k} c USING (question_id) GROUP BY question_id, v.content, n"
        STEPS[f"{_p}k{_k + 1}"] = f"""SELECT * FROM {_p}k{_k} UNION ALL SELECT question_id, content, vec FROM {_v}v JOIN (SELECT question_id, content FROM
            (SELECT *, sum(mass) OVER (PARTITION BY question_id) AS total FROM {_p}j{_k}) WHERE mass > 0 AND {_draw} / mass * total < {B.OVER * _n}) USING (question_id, content)"""
    _last = f"{_p}k{B.ROUNDS}"
    STEPS[f"{_p}o"] = f"SELECT question_id, v.content AS content, n, arg_min(c.content, ({_FAR.format(mu='vec')}, c.content)) AS near FROM {_v}v v JOIN {_last} c USING (question_id) GROUP BY question_id, v.content, n"
    STEPS[f"{_p}r"] = f"SELECT c.question_id AS question_id, c.content AS content, coalesce(w.n, 0) AS n, vec FROM {_last} c LEFT JOIN (SELECT question_id, near, sum(n) AS n FROM {_p}o GROUP BY ALL) w ON c.question_id = w.question_id AND c.content = w.near"
    _seeding(f"{_p}r", f"{_p}r", "truth:kmeans:pick", _n)
    _moving(f"{_p}r", f"{_v}v", f"{_p}rc{_n - 1}", STEPS_MOST)
    for _k in (2, STEPS_MOST):
        STEPS[f"{_p}fin{_k}"] = f"SELECT d.question_id, d.content, d.n, cluster FROM {_v}d d JOIN rep ON d.content = rep.word JOIN {_p}re{_k} e ON e.question_id = d.question_id AND e.content = rep.rep"
# the most likely truth with all defaults: clusters, steps and sweeps
STEPS["fkc"] = f"SELECT kw.*, cluster FROM kw JOIN ffin{STEPS_MOST} USING (question_id, content)"
STEPS["fobs"] = STEPS["obs"].replace("FROM grid g", f"FROM (SELECT question_id, owner_id, unnest(range({Config().clusters}))::INTEGER AS factor FROM ans) g").replace("FROM kc", "FROM fkc")
STEPS["fz0"] = STEPS["z0"].replace("FROM obs", "FROM fobs")
for _k in range(Config().sweeps):
    STEPS[f"fc{_k}"] = _counts(f"fz{_k}", "fobs")
    STEPS[f"fl{_k}"] = _likelihood(f"fz{_k}", f"fc{_k}", "fobs")
    STEPS[f"fz{_k + 1}"] = f"SELECT question_id, factor, CASE WHEN l0 > l1 THEN 0 ELSE 1 END AS indicator FROM fl{_k}"
STEPS["pkc"] = "SELECT kw.*, cluster FROM kw JOIN pfin2 USING (question_id, content)"
STEPS["pobs"] = STEPS["obs"].replace("FROM kc", "FROM pkc")
STEPS["ptop"] = STEPS["top"].replace("FROM sco", "FROM psco")
STEPS["ftop"] = STEPS["top"].replace("FROM sco", "FROM fsco").replace("rank <= 3", f"rank <= {Config().top_k}")
# the mixture, from the fixed centroids
_S = "(sqrt({k} * {k} + ({b}) * ({b})) - ({b}) - CASE WHEN ({a}) = 0 THEN 0 ELSE ({a}) * ln((({a}) + sqrt({k} * {k} + ({b}) * ({b}))) / (({a}) + ({b}))) END)"
_VMF = " + ".join([_S.format(k="kappa", a="nu + 0.5", b="nu + 0.5"), _S.format(k="kl", a="nu", b="nu + 2")]) + " - " + _S.format(k="kl", a="nu + 0.5", b="nu + 0.5")
STEPS["mv0"] = "SELECT question_id, k, mu, total, 1 / total::DOUBLE AS alpha, 1.0::DOUBLE AS kappa FROM (SELECT question_id, sum(n) AS total FROM est GROUP BY question_id) t, cen"
for _k in range(3):
    STEPS[f"mvb{_k}"] = f"SELECT *, ln(alpha) + {_VMF} AS base FROM (SELECT *, least(kappa, sqrt((3 * nu + 5.5::DOUBLE) * (nu + 1.5::DOUBLE))) AS kl FROM (SELECT *, len(mu) / 2.0::DOUBLE - 1 AS nu FROM mv{_k}))"
    STEPS[f"mve{_k}"] = f"SELECT question_id, content, n, vec, arg_max(k, (base + kappa * list_dot_product(vec, mu), -k)) AS cluster FROM est JOIN mvb{_k} USING (question_id) GROUP BY question_id, content, n, vec"
    STEPS[f"mvs{_k}"] = f"SELECT question_id, cluster AS k, dim, sum(n * x) AS value FROM (SELECT question_id, cluster, n, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM mve{_k}) GROUP BY ALL"
    STEPS[f"mvl{_k}"] = f"SELECT question_id, k, sqrt(sum(value * value)) AS length, list(value ORDER BY dim) AS s FROM mvs{_k} GROUP BY question_id, k"
    STEPS[f"mvn{_k}"] = f"SELECT question_id, cluster AS k, sum(n) AS members FROM mve{_k} GROUP BY ALL"
    STEPS[f"mv{_k + 1}"] = f"""SELECT question_id, k, CASE WHEN length < 1e-8 THEN s ELSE list_transform(s, lambda x: x / length) END AS mu, total, alpha,
        CASE WHEN alpha < 1e-6 THEN kappa WHEN abs(r - 1) < 1e-10 THEN 1e10 ELSE (r * len(s) - r * r * r) / nullif(1 - r * r, 0) END AS kappa FROM (SELECT *, length / (total * alpha) AS r FROM
        (SELECT m.question_id, m.k, m.total, m.kappa, (coalesce(members, 0) + 1e-6) / m.total AS alpha, coalesce(length, 0) AS length, coalesce(s, list_transform(m.mu, lambda x: 0.0::DOUBLE)) AS s
         FROM mv{_k} m LEFT JOIN mvl{_k} USING (question_id, k) LEFT JOIN mvn{_k} USING (question_id, k)))"""


def chain(sql: str) -> str:
    """sql with the steps it needs, in order."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)\b", text):
            if name in STEPS and name not in need:
                visit(STEPS[name])
                need[name] = None

    visit(sql)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in need) + "\n" if need else "") + sql


# Spark: the same steps ---------------------------------------------------------


def _model(spark, d):
    return hashed_word_model(chat_answers(spark, d), table(spark, d, "embeddings"))


def _centroids(spark, d, n: int = FACTORS) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") < n).select(F.col("vec_id").cast("int").alias("k"), F.col("embedding").cast("array<double>").alias("mu"))


def _keywords(spark, d):
    return K.keywords(chat_answers(spark, d), corpus.stopwords(spark), _model(spark, d))


def _assigned(spark, d):
    """Distinct words of each question with count, vector and cluster; the join drops words without a vector."""
    model = C.assigned(_model(spark, d), _centroids(spark, d)).withColumnRenamed("word", "content")
    words = K.keywords(chat_answers(spark, d), corpus.stopwords(spark))
    return K.distinct_words(words).join(model.select("content", "vec", "cluster"), "content")


def _worded(spark, d) -> tuple[DataFrame, DataFrame]:
    """Distinct words of each question with count and vector, and the same without vectors, as they are written."""
    model = checkpoints.cut(_model(spark, d).select("word", "vec"))
    names = checkpoints.cut(K.distinct_words(K.keywords(chat_answers(spark, d), corpus.stopwords(spark), model)))
    return K.with_vectors(names, model), names


def _start(spark, d, words: DataFrame) -> DataFrame:
    """The fixed centroids for each question."""
    return words.select("question_id").distinct().join(F.broadcast(C.as_list(_centroids(spark, d), []))).select("question_id", F.inline("centroids"))


def _clustered(spark, d):
    model = C.assigned(_model(spark, d), _centroids(spark, d)).select(F.col("word").alias("content"), "cluster")
    return K.keywords(chat_answers(spark, d), corpus.stopwords(spark)).join(model, "content")


def _observations(spark, d):
    return T.observations(chat_answers(spark, d), _clustered(spark, d), FACTORS)


def _packed(spark, d):
    return T.packed(chat_answers(spark, d), _clustered(spark, d), FACTORS)


def _truth(spark, d):
    return T.synchronous(_packed(spark, d), 3, CONFIG, factors=FACTORS)


def _counts_true(spark, d):
    answers, words = chat_answers(spark, d), checkpoints.cut(_clustered(spark, d))
    truth = T.synchronous(T.packed(answers, words, FACTORS), 3, CONFIG, factors=FACTORS)
    return S.true_words(answers, words, truth)


def _scores(spark, d):
    return S.normalised_scores(_counts_true(spark, d))


def _grades(spark, d):
    """Grades by question and owner from the labels: doc_id gives both."""
    return table(spark, d, "labels").select(F.pmod("doc_id", F.lit(100)).alias("question_id"), F.expr("doc_id div 100").alias("owner_id"), (F.col("quality") * 5.0).alias("score"))


def _placed(spark, d):
    return _assigned(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy("content")) - 1)


# queries ------------------------------------------------------------------------


@query("SELECT question_id, owner_id, pos, content FROM tok")
def tokenize(spark, d):
    return K.tokenized(chat_answers(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT question_id, owner_id, pos, content FROM kw")
def keywords_filtered(spark, d):
    return _keywords(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT question_id, content, count(*) AS n FROM tok GROUP BY ALL")
def keywords_unfiltered(spark, d):
    return K.distinct_words(K.keywords(chat_answers(spark, d)))


@query("SELECT question_id, content FROM voc")
def vocabulary(spark, d):
    return K.vocabulary(K.tokenized(chat_answers(spark, d)))


@query("""SELECT question_id, owner_id, pos, width, rpad(content, width, ' ') AS content FROM
    (SELECT *, (ceil(max(length(content)) OVER (PARTITION BY question_id) / 4.0) * 4)::INTEGER AS width FROM tok)""")
def keyword_padding(spark, d):
    return K.padded(K.tokenized(chat_answers(spark, d))).select("question_id", "owner_id", F.col("pos").cast("long").alias("pos"), "width", "content")


@query("SELECT question_id, owner_id, pos, content FROM tok")
def keyword_unpad(spark, d):
    return K.unpadded(K.padded(K.tokenized(chat_answers(spark, d)))).select("question_id", "owner_id", F.col("pos").cast("long").alias("pos"), "content")


@query("""SELECT word, vec_id, round(sqrt(list_dot_product(vec, vec)), 6) AS norm, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) + 0.0::DOUBLE AS first_value FROM vecs""")
def word_vectors(spark, d):
    m = _model(spark, d)
    return m.select("word", "vec_id", F.round(V.norm(F.col("vec")), 6).alias("norm"), r6(V.normalised(F.col("vec"))[0]).alias("first_value"))


@query("""SELECT e.vec_id, k, round(list_dot_product(e.embedding::DOUBLE[], mu), 6) + 0.0::DOUBLE AS dot, round(2 - 2 * list_dot_product(e.embedding::DOUBLE[], mu), 6) + 0.0::DOUBLE AS signed_distance,
    round(abs(2 - 2 * list_dot_product(e.embedding::DOUBLE[], mu)), 6) + 0.0::DOUBLE AS distance FROM embeddings e, cen""")
def pairwise_distance(spark, d):
    cents = F.broadcast(C.as_list(_centroids(spark, d), []))
    rows = table(spark, d, "embeddings").join(cents).select("vec_id", "embedding", F.explode("centroids").alias("c"))
    a, b = F.col("embedding"), F.col("c.mu")
    return rows.select("vec_id", F.col("c.k").alias("k"), r6(V.dot(a, b)).alias("dot"), r6(V.signed_distance(a, b)).alias("signed_distance"), r6(V.distance(a, b)).alias("distance"))


@query("""
    SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] + p[2])), 6) + 0.0::DOUBLE AS total,
      round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) + 0.0::DOUBLE AS difference,
      round(list_sum(list_transform(a.v, lambda x: x * 2.5::DOUBLE)), 6) + 0.0::DOUBLE AS scaled, a.v = b.v AS equal
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def vector_arith(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return both.select("vec_id", r6(V.total(V.add(a, b))).alias("total"), r6(V.norm(V.subtract(a, b))).alias("difference"), r6(V.total(V.scale(a, 2.5))).alias("scaled"), V.equal(a, b).alias("equal"))


@query("SELECT question_id, content, n, cluster FROM est")
def estep_assign(spark, d):
    return _assigned(spark, d).select("question_id", "content", "n", "cluster")


@query("SELECT question_id, k, dim, round(CASE WHEN length < 1e-8 THEN value ELSE value / length END, 6) + 0.0::DOUBLE AS value FROM sums JOIN lens USING (question_id, k)")
def mstep_centroids(spark, d):
    new = C.recentred(_assigned(spark, d))
    return new.select("question_id", "k", F.posexplode("mu").alias("dim", "value")).select("question_id", "k", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query("""SELECT question_id, cluster AS k, dim, round(sum(w * x), 6) + 0.0::DOUBLE AS value FROM (
    SELECT question_id, cluster, CASE WHEN owner_id <> -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, unnest(vec) AS x, unnest(range(len(vec))) AS dim
    FROM all_ JOIN near ON content = word WHERE content NOT IN (SELECT word FROM stop)) GROUP BY ALL""")
def mstep_weighted(spark, d):
    words = K.filtered(K.with_dummies(K.tokenized(chat_answers(spark, d)), CONFIG), corpus.stopwords(spark), None)  # the join with vectors drops the others
    # dummies weigh nothing; equal words are summed once, by their weight
    weighed = words.groupBy("question_id", "content").agg(F.sum(F.when(F.col("owner_id") != -1, 1.0).otherwise(0.0)).alias("w"))
    model = C.assigned(_model(spark, d), _centroids(spark, d)).withColumnRenamed("word", "content")  # a word once, not for each question
    found = weighed.join(model, "content")
    return C.vector_sums(found, F.col("w")).select("question_id", "k", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query("""SELECT question_id, round(sum(sqrt(CASE WHEN n.mu IS NULL THEN list_dot_product(c.mu, c.mu) ELSE list_sum(list_transform(list_zip(c.mu, n.mu), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) END)), 6) AS moved
    FROM (SELECT question_id, cen.* FROM (SELECT DISTINCT question_id FROM est), cen) c LEFT JOIN newc n USING (question_id, k) GROUP BY question_id""")
def convergence(spark, d):
    words = _assigned(spark, d)
    old = words.select("question_id").distinct().join(F.broadcast(C.as_list(_centroids(spark, d), []))).select("question_id", F.inline("centroids"))
    return C.movement(old, C.recentred(words)).select("question_id", r6("moved").alias("moved"))


@query("SELECT question_id, pos, round(mass, 6) + 0.0::DOUBLE AS mass, round(cdf, 6) AS cdf FROM mass")
def kmeanspp_mass(spark, d):
    words = _placed(spark, d)
    centers = words.select("question_id").distinct().join(F.broadcast(C.as_list(_centroids(spark, d, 3), []))).select("question_id", F.inline("centroids"))
    return C.seeding_mass(words, centers).select("question_id", F.col("pos").cast("long").alias("pos"), r6("mass").alias("mass"), r6("cdf").alias("cdf"))


@query("""SELECT question_id, coalesce(min(CASE WHEN cdf > ('0x' || substr(md5('pick|' || question_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE THEN pos END), max(CASE WHEN mass > 0 THEN pos END), max(pos)) AS pos FROM mass GROUP BY question_id""")
def kmeanspp_pick(spark, d):
    words = _placed(spark, d)
    centers = words.select("question_id").distinct().join(F.broadcast(C.as_list(_centroids(spark, d, 3), []))).select("question_id", F.inline("centroids"))
    return C.picked(C.seeding_mass(words, centers), uniform("pick", "question_id")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT question_id, cluster, sum(n)::BIGINT AS n FROM est GROUP BY ALL")
def cluster_histogram(spark, d):
    return C.histogram(_assigned(spark, d))


@query("SELECT question_id, owner_id, factor, obs FROM obs")
def observations(spark, d):
    return _observations(spark, d)


@query("SELECT owner_id, n00, n01, n10, n11 FROM c0")
def prior_counts(spark, d):
    o = _observations(spark, d)
    return T.prior_counts(o, T.initial_truth(o))


@query("SELECT question_id, factor, round(l0, 6) + 0.0::DOUBLE AS l0, round(l1, 6) + 0.0::DOUBLE AS l1 FROM l0")
def ltm_loglik(spark, d):
    o = _observations(spark, d)
    z = T.initial_truth(o)
    return T.log_likelihood(o, z, T.prior_counts(o, z), CONFIG).select("question_id", "factor", r6("l0").alias("l0"), r6("l1").alias("l1"))


@query("SELECT question_id, factor, indicator FROM z3")
def ltm_map(spark, d):
    return _truth(spark, d)


@query("SELECT question_id, factor, indicator FROM d3")
def ltm_draw(spark, d):
    return T.synchronous(_packed(spark, d), 3, CONFIG, draw=True, factors=FACTORS)


@query(f"SELECT question_id, factor, indicator FROM d{SWEEPS_MOST}")
def ltm_draw_sweeps(spark, d):
    """Twenty sweeps, whose counts only follow the flips."""
    return T.synchronous(_packed(spark, d), SWEEPS_MOST, CONFIG, draw=True, factors=FACTORS)


@query("SELECT owner_id, n00, n01, n10, n11 FROM dc3")
def ltm_counts(spark, d):
    """Counts of the owners after three drawn sweeps, kept up by flips."""
    answers = checkpoints.cut(_packed(spark, d))
    coin = T.initial_truth(T.unpacked(answers, FACTORS), CONFIG.seed).withColumnRenamed("indicator", "obs").withColumn("owner_id", F.lit(0))
    truth = checkpoints.cut(T.repacked(coin, FACTORS).select("question_id", F.col("obs").alias("z")))
    counts = checkpoints.cut(T.packed_counts(answers, truth, FACTORS))
    for k in range(3):
        likelihood = T.packed_likelihood(answers, truth, counts, T.Terms(FACTORS, CONFIG))
        truth = checkpoints.cut(T.swept(likelihood, FACTORS, True, CONFIG.seed, k))
        counts = checkpoints.cut(T.changed_counts(counts, answers, truth, FACTORS))
    return counts.select("owner_id", "n00", "n01", "n10", "n11")


@query()
def ltm_gibbs(spark, d):
    return T.gibbs(_observations(spark, d), Config(clusters=FACTORS, sweeps=20))


@query("SELECT question_id, owner_id, n_true FROM cnt")
def answer_truth_count(spark, d):
    return _counts_true(spark, d)


@query("SELECT question_id, owner_id, round(score, 6) AS score FROM sco")
def answer_truth_norm(spark, d):
    return _scores(spark, d).withColumn("score", r6("score"))


@query("SELECT owner_id, round(sum(score), 6) AS trust FROM sco GROUP BY owner_id")
def user_truth(spark, d):
    return S.owner_trust(_scores(spark, d)).withColumn("trust", r6("trust"))


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM top")
def topk_answers(spark, d):
    return S.top_answers(_scores(spark, d), 3).select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("""SELECT question_id, owner_id, row_number() OVER (PARTITION BY question_id ORDER BY floor(score * 1e6::DOUBLE) / 1e6::DOUBLE DESC, owner_id) AS rank FROM sco QUALIFY rank <= 3""")
def topk_truncated(spark, d):
    return S.top_answers(_scores(spark, d), 3, S.truncated(F.col("score"))).select("question_id", "owner_id", "rank")


@query("SELECT exam_id, question_id, n_questions FROM exq")
def exam_assignment(spark, d):
    return S.exam_of(chat_answers(spark, d), corpus.exams(spark))


@query("SELECT exam_id, round(sum(lab.score) / (3 * max(n_questions)), 6) AS average FROM top JOIN lab USING (question_id, owner_id) JOIN exq USING (question_id) GROUP BY exam_id")
def exam_scores(spark, d):
    top = S.top_answers(_scores(spark, d), 3).drop("score")
    return S.exam_scores(top, _grades(spark, d), S.exam_of(chat_answers(spark, d), corpus.exams(spark)), 3).select("exam_id", r6("average").alias("average"))


@query("SELECT round(avg(lab.score), 6) AS average FROM top JOIN lab USING (question_id, owner_id)")
def overall_score(spark, d):
    top = S.top_answers(_scores(spark, d), 3).drop("score")
    return S.overall_score(top, _grades(spark, d), 3).select(r6("average").alias("average"))


@query("SELECT max(n) AS most FROM (SELECT question_id, count(*) AS n FROM ans GROUP BY question_id)")
def answers_max(spark, d):
    return S.most_answers(chat_answers(spark, d))


@query("SELECT question_id, owner_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, owner_id) - 1 AS place FROM sco")
def sort_scores(spark, d):
    return K.ordered(_scores(spark, d), "score", descending=True).select("question_id", "owner_id", F.col("place").cast("long").alias("place"))


@query("SELECT question_id, owner_id, pos, content, row_number() OVER (PARTITION BY question_id ORDER BY content, owner_id, pos) - 1 AS place FROM kw")
def sort_keywords(spark, d):
    return K.ordered(_keywords(spark, d), "content").withColumns({"place": F.col("place").cast("long"), "pos": F.col("pos").cast("long")})


@query("""SELECT question_id, owner_id, pos, content, row_number() OVER (PARTITION BY question_id ORDER BY ('0x' || substr(md5('shuffle|' || question_id || '|' || owner_id || '|' || pos || '|' || content), 1, 8))::BIGINT, owner_id, pos) - 1 AS place FROM kw""")
def hash_shuffle(spark, d):
    return K.shuffled(_keywords(spark, d)).withColumns({"place": F.col("place").cast("long"), "pos": F.col("pos").cast("long")})


@query("SELECT question_id, n_words, alpha FROM alp")
def dummy_alpha(spark, d):
    size = K.vocabulary(K.tokenized(chat_answers(spark, d))).groupBy("question_id").agg(F.count("*").alias("n_words"))
    return size.withColumn("alpha", K.gamma_alpha(F.col("n_words")))


@query("SELECT question_id, content, alpha, n FROM gam")
def dummy_gamma(spark, d):
    words = K.vocabulary(K.tokenized(chat_answers(spark, d)))
    size = words.groupBy("question_id").agg(K.gamma_alpha(F.count("*")).alias("alpha"))
    return words.join(size, "question_id").withColumn("n", K.gamma(uniform("truth:gamma", "question_id", "content"), F.col("alpha")))


@query("""SELECT question_id, content, alpha, least(greatest(CASE WHEN u <= 0.5 - (1 - exp(-3.0::DOUBLE)) / 4 THEN -ceil(ln(u / (0.5 - (1 - exp(-3.0::DOUBLE)) / 4)) / ln(exp(-3.0::DOUBLE)))::INTEGER
    WHEN u <= 0.5 + (1 - exp(-3.0::DOUBLE)) / 4 THEN 0 ELSE ceil(ln((1 - u) / (0.5 - (1 - exp(-3.0::DOUBLE)) / 4)) / ln(exp(-3.0::DOUBLE)))::INTEGER END + alpha, 0), 2 * alpha) AS n FROM gam0""")
def dummy_gamma_exact(spark, d):
    """With a geometric left tail too."""
    words = K.vocabulary(K.tokenized(chat_answers(spark, d)))
    size = words.groupBy("question_id").agg(K.gamma_alpha(F.count("*")).alias("alpha"))
    return words.join(size, "question_id").withColumn("n", K.gamma(uniform("truth:gamma", "question_id", "content"), F.col("alpha"), exact=True))


@query("SELECT question_id, owner_id, content, count(*) AS n FROM all_ GROUP BY ALL")
def dummy_words(spark, d):
    words = K.with_dummies(K.tokenized(chat_answers(spark, d)), CONFIG)
    return words.groupBy("question_id", "owner_id", "content").agg(F.count("*").alias("n"))


@query("SELECT question_id, owner_id, pos, content FROM tok")
def drop_dummies(spark, d):
    return K.without_dummies(K.with_dummies(K.tokenized(chat_answers(spark, d)), CONFIG)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT s_suppkey, round(c, 6) + 0.0::DOUBLE AS log_constant, round(ln(0.25::DOUBLE) + c + k * 0.5::DOUBLE, 6) + 0.0::DOUBLE AS log_density FROM (
    SELECT s_suppkey, kappa AS k, {_VMF} AS c FROM (SELECT *, least(kappa, sqrt((3 * nu + 5.5::DOUBLE) * (nu + 1.5::DOUBLE))) AS kl FROM
    (SELECT s_suppkey, (s_suppkey % 50 + 1) * 2.0::DOUBLE AS kappa, (s_suppkey % 7 + 2) * 10 / 2.0::DOUBLE - 1 AS nu FROM supplier)))""")
def vmf_log_c(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 50 + 1) * 2.0).alias("k"), ((F.col("s_suppkey") % 7 + 2) * 10).alias("dimension"))
    s = s.withColumn("c", V.vmf_log_constant(F.col("k"), F.col("dimension")))
    return s.select("s_suppkey", r6("c").alias("log_constant"), r6(V.vmf_log_density(F.lit(0.25), F.col("c"), F.col("k"), F.lit(0.5))).alias("log_density"))


@query("""SELECT question_id, k, round(m / total, 6) AS alpha, round(r, 6) AS r, CASE WHEN 1 - r * r >= 1e-3 THEN round((r * d - r * r * r) / (1 - r * r), 4) END AS kappa
    FROM (SELECT *, length / m AS r FROM (SELECT *, (sum(m) OVER (PARTITION BY question_id))::DOUBLE AS total FROM (SELECT question_id, cluster AS k, sum(n)::DOUBLE AS m FROM est GROUP BY ALL)) JOIN lens USING (question_id, k))""")
def movmf_params(spark, d):
    """kappa is null where 1 - r^2 is too small to be rounded alike by two engines; mixture_parameters() has it."""
    p = C.mixture_parameters(_assigned(spark, d))
    kappa = F.when(1 - F.col("r") * F.col("r") >= 1e-3, F.round("kappa", 4))
    return p.select("question_id", "k", r6("alpha").alias("alpha"), r6("r").alias("r"), kappa.alias("kappa"))


@query("SELECT question_id, content, n, cluster FROM mve2")
def movmf_steps(spark, d):
    """Two steps of the mixture from the fixed centroids."""
    words, names = _worded(spark, d)
    return C.movmf(words, _start(spark, d, names), 2, names=names)[0].select("question_id", "content", "n", "cluster")


@query("""SELECT id, exam, item, row_number() OVER (ORDER BY exam, item) - 1 AS place FROM
    (SELECT (item_id % 12 + 1) || '.' || (item_id // 12 + 1) AS id, (item_id % 12 + 1)::INTEGER AS exam, (item_id // 12 + 1)::INTEGER AS item FROM benchmark)""")
def renumber(spark, d):
    ids = table(spark, d, "benchmark").select(F.concat_ws(".", F.col("item_id") % 12 + 1, F.expr("item_id div 12 + 1")).alias("id"))
    return corpus.renumbered(ids)


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(trim((item_id % 12 + 1) || '.' || item_id || '  ' || text), '^\S+\s*', ''), '\s+', ' ', 'g')) AS value FROM benchmark""")
def strip_ids(spark, d):
    line = F.concat((F.col("item_id") % 12 + 1).cast("string"), F.lit("."), F.col("item_id").cast("string"), F.lit("  "), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", strip_id(line).alias("value"))


_LINES = "CASE WHEN turn = 0 THEN ';Node' WHEN turn = 5 THEN ';Edge' WHEN turn = 3 THEN 'x' ELSE CAST((conv_id + turn) % 3 AS {t}) || chr(9) || 'a' END"


@query(f"""SELECT file, count_if(v = 0) AS zero, count_if(v <> 0) AS nonzero FROM (SELECT file, CAST(regexp_extract(value, '^[0-9]+') AS INTEGER) AS v FROM
    (SELECT *, max(CASE WHEN value LIKE ';Edge%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS seen FROM
    (SELECT CAST(conv_id AS VARCHAR) AS file, turn AS line, {_LINES.format(t="VARCHAR")} AS value FROM conversations)) WHERE seen = 0 AND regexp_matches(value, '^[0-9]')) GROUP BY file""")
def section_counts(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), F.expr(_LINES.format(t="STRING")).alias("value"))
    return corpus.label_counts(lines)


@query(f"""SELECT sum(zero)::BIGINT AS zero, sum(nonzero)::BIGINT AS nonzero FROM (SELECT count_if(v = 0) AS zero, count_if(v <> 0) AS nonzero FROM (SELECT CAST(regexp_extract(value, '^[0-9]+') AS INTEGER) AS v FROM
    (SELECT *, max(CASE WHEN value LIKE ';Edge%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS seen FROM
    (SELECT CAST(conv_id AS VARCHAR) AS file, turn AS line, {_LINES.format(t="VARCHAR")} AS value FROM conversations)) WHERE seen = 0 AND regexp_matches(value, '^[0-9]')))""")
def section_totals(spark, d):
    return corpus.label_totals(section_counts(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE o_orderkey END AS selected, CASE WHEN o_totalprice > 100000 THEN rpad(o_orderstatus, 4, ' ') ELSE 'none' END AS word,
    CASE WHEN o_totalprice > 100000 THEN floor(o_totalprice / 3 * 1e6::DOUBLE) / 1e6::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders""")
def select_masked(spark, d):
    big = F.col("o_totalprice") > 100000
    return table(spark, d, "orders").select(
        "o_orderkey",
        S.masked_select(big, F.col("o_custkey"), F.col("o_orderkey")).alias("selected"),
        S.masked_select(big, F.rpad("o_orderstatus", 4, " "), F.lit("none")).alias("word"),
        S.masked_select(big, S.truncated(F.col("o_totalprice") / 3), F.lit(0.0)).alias("score"),
    )


@query("""SELECT o_orderkey, (CASE WHEN o_orderpriority < '3' THEN o_orderstatus ELSE 'none' END) AS content, CASE WHEN o_orderpriority < '3' THEN o_custkey ELSE -1 END AS owner_id,
    CASE WHEN o_orderpriority < '3' THEN [o_totalprice, 1.0::DOUBLE] ELSE [0.0::DOUBLE, 0.0::DOUBLE] END AS vec FROM orders""")
def select_struct(spark, d):
    """A keyword, its owner and its vector selected at once."""
    keyword = lambda content, owner, vec: F.struct(content.alias("content"), owner.cast("long").alias("owner_id"), vec.alias("vec"))
    own = keyword(F.col("o_orderstatus"), F.col("o_custkey"), F.array(F.col("o_totalprice").cast("double"), F.lit(1.0)))
    none = keyword(F.lit("none"), F.lit(-1), F.array(F.lit(0.0), F.lit(0.0)))
    return table(spark, d, "orders").select("o_orderkey", S.masked_select(F.col("o_orderpriority") < "3", own, none).alias("k")).select("o_orderkey", "k.*")


_SERIES = "SELECT ({n} // 10 + 1)::INTEGER AS exam_id, ({n} % 10 + 1)::INTEGER AS top_k, {v} AS score FROM {t}"
STEPS["ser1"] = _SERIES.format(n="p_partkey", v="p_retailprice", t="part")
STEPS["ser2"] = _SERIES.format(n="s_suppkey", v="s_acctbal", t="supplier")


def _series(spark, d):
    lines = lambda t, n, v: table(spark, d, t).select(F.col(n).alias("line"), F.col(v).cast("string").alias("value"))
    return corpus.series(lines("part", "p_partkey", "p_retailprice")), corpus.series(lines("supplier", "s_suppkey", "s_acctbal"))


@query("SELECT exam_id, top_k, ser1.score AS plain, ser2.score AS padded FROM ser1 JOIN ser2 USING (exam_id, top_k)")
def reshape_series(spark, d):
    return corpus.paired(*_series(spark, d))


@query("SELECT exam_id, top_k, 'plain' AS variant, score FROM ser1 UNION ALL SELECT exam_id, top_k, 'padded' AS variant, score FROM ser2")
def tidy_series(spark, d):
    plain, padded = _series(spark, d)
    return corpus.tidy(plain=plain, padded=padded)


# corpus files: written from the driver's tables, read by the corpus readers

_QUESTION = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)"


def _dataset(spark, d) -> dict[str, DataFrame]:
    """Documents as answers, labels as grades, nations as questions, in files."""
    root = checkpoints.folder(spark)
    line = F.regexp_replace("text", "[\\r\\n]", " ")
    corpus.save_lines(table(spark, d, "documents").select(F.expr(_QUESTION).alias("question_id"), "doc_id", line.alias("value")), f"{root}/answers", order="doc_id")
    corpus.save_lines(table(spark, d, "labels").select(F.pmod("doc_id", F.lit(100)).alias("question_id"), "doc_id", (F.col("quality") * 5.0).alias("value")), f"{root}/scores", order="doc_id")
    corpus.save_lines(table(spark, d, "nation").select(F.lit(0).alias("question_id"), "n_nationkey", F.col("n_name").alias("value")), f"{root}/questions/questions", order="n_nationkey")
    return corpus.dataset(spark, root)


@query(f"SELECT {_QUESTION} AS question_id, row_number() OVER (PARTITION BY {_QUESTION} ORDER BY doc_id) - 1 AS owner_id, regexp_replace(text, '[\r\n]', ' ', 'g') AS raw_answer FROM documents")
def load_answers(spark, d):
    return _dataset(spark, d)["answers"]


@query("SELECT (doc_id % 100)::INTEGER AS question_id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) - 1 AS owner_id, (quality * 5.0)::FLOAT AS score FROM labels WHERE quality IS NOT NULL")
def load_scores(spark, d):
    return _dataset(spark, d)["scores"].withColumn("owner_id", F.col("owner_id").cast("long"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS question_id, n_name AS content, 30 AS key_factor_number FROM nation")
def load_questions(spark, d):
    return _dataset(spark, d)["questions"]


@query("""SELECT 'w' || vec_id AS word, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 4) + 0.0::DOUBLE AS first_value FROM
    (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def word_model_files(spark, d):
    """Vectors as text lines, read at unit length, saved as a model and loaded again."""
    root = checkpoints.folder(spark)
    line = F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.col("embedding").cast("array<string>"))
    table(spark, d, "embeddings").select(line.alias("value")).write.text(f"{root}/vectors")
    corpus.save_word_model(corpus.raw_word_model(spark, f"{root}/vectors"), f"{root}/model")
    m = corpus.load_word_model(spark, f"{root}/model")
    return m.select("word", F.round(V.norm(F.col("vec")), 4).alias("norm"), (F.round(F.col("vec")[0].cast("double"), 4) + 0.0).alias("first_value"))


@query("SELECT question_id, owner_id, raw_answer FROM (SELECT conv_id AS question_id, turn % 2 AS owner_id, text AS raw_answer, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def first_answers(spark, d):
    """Of the answers of an owner to a question the first stays."""
    rows = chat_answers(spark, d).withColumn("turn", F.col("owner_id")).withColumn("owner_id", F.col("turn") % 2)
    return corpus.unique_answers(rows, order="turn")


@query("""SELECT question_id, owner_id, id, line, score FROM (SELECT *, dense_rank() OVER (ORDER BY exam, item) - 1 AS question_id, row_number() OVER (PARTITION BY id ORDER BY line) - 1 AS owner_id FROM
    (SELECT (doc_id % 12 + 1) AS exam, (doc_id % 7 + 1) AS item, (doc_id % 12 + 1) || '.' || (doc_id % 7 + 1) AS id, doc_id AS line, quality * 5.0::DOUBLE AS score FROM labels) WHERE id NOT IN ('2.1', '3.4'))""")
def scores_renumbered(spark, d):
    """Grades with ids `exam.item`, two of them excluded, by the place of their id."""
    labels = table(spark, d, "labels")
    rows = labels.select(F.concat_ws(".", F.col("doc_id") % 12 + 1, F.col("doc_id") % 7 + 1).alias("id"), F.col("doc_id").alias("line"), (F.col("quality") * 5.0).alias("score"))
    return corpus.collected_scores(rows, exclude=("2.1", "3.4")).select("question_id", "owner_id", "id", "line", "score")


@query("""SELECT question_id, owner_id, id, score FROM (SELECT *, dense_rank() OVER (ORDER BY exam, item) - 1 AS question_id, row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS owner_id FROM
    (SELECT (doc_id % 12 + 1) AS exam, (doc_id % 11 + 1) AS item, (doc_id % 12 + 1) || '.' || (doc_id % 11 + 1) AS id, doc_id, (quality * 4.5)::FLOAT AS score FROM labels WHERE quality IS NOT NULL))""")
def raw_tree(spark, d):
    """A raw tree of grades, a folder for each id and a file for each grader, written, read and renumbered."""
    root = checkpoints.folder(spark)
    labels = table(spark, d, "labels").where("quality IS NOT NULL")
    rows = labels.select(F.concat_ws(".", F.col("doc_id") % 12 + 1, F.col("doc_id") % 11 + 1).alias("id"), F.col("doc_id").alias("line"), F.col("quality"))
    grades = F.array(*[F.struct(F.lit(g).alias("grader"), (F.col("quality") * x).alias("value")) for g, x in (("ave", 4.5), ("me", 4.0), ("other", 5.0))])
    corpus.save_raw_tree(rows.select("id", "line", F.inline(grades)), root, "id", "grader")
    return corpus.collected_tree(spark, root)


@query("SELECT question_id, owner_id, pos, content, row_number() OVER (PARTITION BY question_id ORDER BY length(content), reverse(content), owner_id, pos) - 1 AS place FROM kw")
def sort_by_expression(spark, d):
    return K.ordered(_keywords(spark, d), F.char_length("content"), F.reverse("content")).withColumns({"place": F.col("place").cast("long"), "pos": F.col("pos").cast("long")})


STEPS["rnk"] = "SELECT question_id, owner_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, owner_id) AS rank FROM sco"


@query("""SELECT exam_id, top_k, round(sum(lab.score) / (top_k * max(n_questions)), 6) AS average FROM rnk JOIN (SELECT unnest(range(1, 11))::INTEGER AS top_k) t ON rank <= top_k
    JOIN lab USING (question_id, owner_id) JOIN exq USING (question_id) GROUP BY exam_id, top_k""")
def exam_report(spark, d):
    """Mean grade of the best answers of each exam for K from 1 to 10, as the sink wrote it."""
    ranked = S.top_answers(_scores(spark, d), 10)
    report = S.exam_report(ranked, _grades(spark, d), S.exam_of(chat_answers(spark, d), corpus.exams(spark)), 10)
    return corpus.save_results(report.select("exam_id", "top_k", r6("average").alias("average")), checkpoints.folder(spark))


def _seeded(spark, d, weigh) -> DataFrame:
    """Centers by k-means++; words are written without vectors. weigh: from keywords to distinct words with counts."""
    model = checkpoints.cut(_model(spark, d))
    words = weigh(K.keywords(chat_answers(spark, d), corpus.stopwords(spark), model))
    words = checkpoints.cut(words.withColumn("pos", F.col("content")))
    return C.initial_centers(K.with_vectors(words, model), FACTORS, "truth:kmeans", names=words)


_CENTERS = "SELECT question_id, k, round(mu[1], 6) + 0.0::DOUBLE AS first_value, round(mu[len(mu)], 6) + 0.0::DOUBLE AS last_value FROM {c}"


def _centers(centers: DataFrame) -> DataFrame:
    return centers.select("question_id", "k", r6(F.col("mu")[0]).alias("first_value"), r6(F.element_at("mu", -1)).alias("last_value"))


@query(_CENTERS.format(c=f"pc{FACTORS - 1}"))
def kmeanspp_centers(spark, d):
    return _centers(_seeded(spark, d, K.distinct_words))


@query(_CENTERS.format(c=f"wc{FACTORS - 1}"))
def kmeanspp_centers_weightless(spark, d):
    return _centers(_seeded(spark, d, _odd_weightless))


@query("SELECT word, rep FROM rep")
def vector_dictionary(spark, d):
    """The smallest word of the same vector."""
    return B.dictionary(_model(spark, d))


@query("SELECT question_id, content, n FROM pv")
def collapsed_words(spark, d):
    """Words of a question whose vectors are equal, as one."""
    return B.collapsed(K.distinct_words(_keywords(spark, d)), B.dictionary(_model(spark, d)))


def _parallel_seeds(spark, d, weigh) -> DataFrame:
    model = checkpoints.cut(_model(spark, d))
    words = weigh(K.keywords(chat_answers(spark, d), corpus.stopwords(spark)))  # the join with the dictionary drops the others
    names = checkpoints.cut(B.collapsed(words, B.dictionary(model)))
    found = B.seeded(K.with_vectors(names, model), FACTORS, "truth:kmeans", names)
    return _centers(found.select("question_id", F.posexplode("centers").alias("k", "mu")))


@query(_CENTERS.format(c=f"prc{FACTORS - 1}"))
def kmeans_parallel_seeds(spark, d):
    return _parallel_seeds(spark, d, K.distinct_words)


def _odd_weightless(words: DataFrame) -> DataFrame:
    """Distinct words with counts, where words of odd owners are dummies."""
    return K.weighed_words(words.withColumn("owner_id", F.when(F.col("owner_id") % 2 == 1, -1).otherwise(F.col("owner_id"))))


@query(_CENTERS.format(c=f"wrc{FACTORS - 1}"))
def kmeans_parallel_seeds_weightless(spark, d):
    return _parallel_seeds(spark, d, _odd_weightless)


@query("SELECT question_id, content, n, cluster FROM pfin2")
def sphere_kmeans(spark, d):
    """k-means|| and two steps. Words without a vector go with the join of the dictionary."""
    words = K.distinct_words(K.keywords(chat_answers(spark, d), corpus.stopwords(spark)))
    return B.clusters(checkpoints.cut(words), _model(spark, d), FACTORS, "truth:kmeans", 2)


@query("SELECT question_id, content, n, cluster FROM pfin2")
def sphere_kmeans_blocks(spark, d):
    """As sphere_kmeans, with blocks of 16 vectors, so that questions are spread over several."""
    words = K.distinct_words(K.keywords(chat_answers(spark, d), corpus.stopwords(spark)))
    return B.clusters(checkpoints.cut(words), _model(spark, d), FACTORS, "truth:kmeans", 2, size=16)


@query("SELECT question_id, content, n, cluster FROM wfin2")
def sphere_kmeans_weightless(spark, d):
    return B.clusters(checkpoints.cut(_odd_weightless(K.keywords(chat_answers(spark, d), corpus.stopwords(spark)))), _model(spark, d), FACTORS, "truth:kmeans", 2)


@query(f"SELECT question_id, content, n, cluster FROM pfin{STEPS_MOST}")
def sphere_kmeans_converged(spark, d):
    """k-means|| and as many steps as it takes until no center moves."""
    return B.clusters(checkpoints.cut(K.distinct_words(_keywords(spark, d))), _model(spark, d), FACTORS, "truth:kmeans")


@query("SELECT question_id, content, n, cluster FROM est3")
def sphere_kmeans_steps(spark, d):
    """Two steps from the fixed centroids."""
    words, names = _worded(spark, d)
    found, _ = C.kmeans(words, _start(spark, d, names), max_iter=2, names=names)
    return found.select("question_id", "content", "n", "cluster")


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM top")
def truth_plain_map(spark, d):
    found = discover(chat_answers(spark, d), _model(spark, d), corpus.stopwords(spark), CONFIG, centroids=_centroids(spark, d), inference="map", sweeps=3)
    return found.top.select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM top")
def truth_padded_map(spark, d):
    found = discover(chat_answers(spark, d), _model(spark, d), corpus.stopwords(spark), CONFIG, "padded", _centroids(spark, d), "map", 3)
    return found.top.select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM ptop")
def truth_plain(spark, d):
    """The path of the defaults, with fewer clusters, steps and sweeps, which SQL can follow draw by draw: k-means||, k-means, drawn truth."""
    found = discover(chat_answers(spark, d), _model(spark, d), corpus.stopwords(spark), CONFIG)
    return found.top.select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM ptop")
def truth_padded(spark, d):
    """As truth_plain, with dummy words, which weigh nothing in k-means."""
    found = discover(chat_answers(spark, d), _model(spark, d), corpus.stopwords(spark), CONFIG, "padded")
    return found.top.select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("SELECT question_id, owner_id, rank, round(score, 6) AS score FROM ftop")
def truth_full_map(spark, d):
    """All defaults in full: 30 clusters, k-means until no center moves, and most likely truths for up to 100 sweeps."""
    found = discover(chat_answers(spark, d), _model(spark, d), corpus.stopwords(spark), Config(), inference="map")
    return found.top.select("question_id", "owner_id", "rank", r6("score").alias("score"))


@query("SELECT word, count(content) AS n FROM stop LEFT JOIN tok ON content = word GROUP BY word")
def stopword_list(spark, d):
    """Stopwords and how often the answers have them."""
    found = K.tokenized(chat_answers(spark, d)).groupBy(F.col("content").alias("word")).agg(F.count("*").alias("n"))
    return corpus.stopwords(spark).join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS question_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS owner_id, doc_id FROM documents""")
def document_owners(spark, d):
    return document_answers(spark, d).select("question_id", "owner_id", "doc_id")
