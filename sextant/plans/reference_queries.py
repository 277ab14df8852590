"""Queries over search, filtering, chunking and maintenance, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import lang as L
from sextant.functions import text as X
from sextant.functions import vectors as V
from sextant.operators import ann, chunk_code, chunk_text, dml, embed, fulltext, incremental, search
from sextant.operators.knn import knn, knn_batch, lookup_vector, lookup_vectors, recommend
from sextant.plans.spec import QuerySpec, VectorSearch
from sextant.session import materialise, stored
from sextant.session import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ shared parts


def chunks_view(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their vectors in the shape of the chunk table."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    return e.join(d, e.vec_id == d.doc_id).select(
        e.vec_id.alias("chunk_id"), F.concat(d.source, F.lit("/"), d.doc_id.cast("string"), F.lit(".txt")).alias("file_path"), d.lang.alias("language"),
        d.text.alias("code"), d.n_chars, e.label, F.when(e.label < 5, "code").otherwise("docs").alias("embedding_type"), e.embedding.alias("vector"),
    )


def qv(spark: SparkSession, sf: str, i: int) -> list[float]:
    return lookup_vector(table(spark, sf, "embeddings"), i, "vec_id", "embedding")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + F.lit(0.0))


_VIEW = """chunks_view AS (SELECT e.vec_id AS chunk_id, d.source || '/' || d.doc_id || '.txt' AS file_path, d.lang AS language, d.text AS code, d.n_chars, e.label,
  CASE WHEN e.label < 5 THEN 'code' ELSE 'docs' END AS embedding_type, e.embedding AS vector FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""


def _dist(v: str, q: str) -> str:
    return f"list_sum(list_transform(list_zip({v}, {q}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _dot(v: str, q: str) -> str:
    return f"list_sum(list_transform(list_zip({v}, {q}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _q(i: int) -> str:
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {i})"


# ------------------------------------------------------------------ nearest neighbours


def _knn(spark, sf, k, metric="l2"):
    return _rounded(knn(table(spark, sf, "embeddings"), qv(spark, sf, 0), k, id_col="vec_id", vector="embedding", metric=metric, columns=["vec_id"]))


def _knn_sql(score: str, k: int) -> str:
    return f"SELECT vec_id, round({score}, 6) + 0.0 AS score FROM (SELECT vec_id, embedding FROM embeddings) ORDER BY {score}, vec_id LIMIT {k}"


@query(_knn_sql(_dist("embedding", _q(0)), 10))
def q01_knn_l2(spark, sf):
    return _knn(spark, sf, 10)


@query(_knn_sql(f"(1 - {_dot('embedding', _q(0))} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot(_q(0), _q(0))})))", 10))
def q02_knn_cosine(spark, sf):
    return _knn(spark, sf, 10, "cosine")


@query(_knn_sql(f"(-{_dot('embedding', _q(0))})", 10))
def q03_knn_dot(spark, sf):
    return _knn(spark, sf, 10, "dot")


for _name, _k in (("q04_knn_k1", 1), ("q05_knn_k3", 3), ("q06_knn_k20", 20)):
    QUERIES[_name] = lambda spark, sf, k=_k: _knn(spark, sf, k)
    SQL[_name] = _knn_sql(_dist("embedding", _q(0)), _k)


def _pre(spark, sf, where):
    return _rounded(knn(chunks_view(spark, sf), qv(spark, sf, 0), 10, where, columns=["chunk_id", "file_path", "embedding_type"]))


def _pre_sql(where: str) -> str:
    d = _dist("vector", _q(0))
    return f"WITH {_VIEW} SELECT chunk_id, file_path, embedding_type, round({d}, 6) AS score FROM chunks_view WHERE {where} ORDER BY {d}, chunk_id LIMIT 10"


@query(_pre_sql("embedding_type = 'code'"))
def q07_knn_prefilter_eq(spark, sf):
    return _pre(spark, sf, F.col("embedding_type") == "code")


@query(_pre_sql("language IN ('en', 'de') AND file_path LIKE 'issue%'"))
def q08_knn_prefilter_in_like(spark, sf):
    return _pre(spark, sf, "language IN ('en', 'de') AND file_path LIKE 'issue%'")


@query(_pre_sql("n_chars BETWEEN 500 AND 3000 OR label >= 8"))
def q09_knn_prefilter_between_or(spark, sf):
    return _pre(spark, sf, "n_chars BETWEEN 500 AND 3000 OR label >= 8")


@query(f"""WITH {_VIEW}, top AS (SELECT chunk_id, label, {_dist('vector', _q(0))} AS score FROM chunks_view ORDER BY score, chunk_id LIMIT 15)
SELECT chunk_id, label, round(score, 6) AS score FROM top WHERE label IN (1, 2, 3) ORDER BY score, chunk_id LIMIT 3""")
def q10_knn_postfilter(spark, sf):
    spec = QuerySpec(columns=("chunk_id", "label"), where="label IN (1, 2, 3)", limit=3, vector_search=VectorSearch(qv(spark, sf, 0), 15))
    return _rounded(spec.apply(chunks_view(spark, sf).select("chunk_id", "label", "vector")))


@query(f"""SELECT query_id, vec_id, round(score, 6) AS score, rn FROM (SELECT q.vec_id AS query_id, e.vec_id, {_dist('e.embedding', 'q.embedding')} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_dist('e.embedding', 'q.embedding')}, e.vec_id) AS rn
FROM embeddings e JOIN embeddings q ON q.vec_id < 5) WHERE rn <= 5""")
def q11_knn_batch(spark, sf):
    e = table(spark, sf, "embeddings")
    return _rounded(knn_batch(e, lookup_vectors(e, range(5), "vec_id", "embedding"), 5, "vec_id", "embedding").select("query_id", "vec_id", "score", "rn"))


def _recommend_sql(where: str) -> str:
    d = _dist("embedding", _q(7))
    return f"SELECT vec_id, label, round({d}, 6) AS score FROM embeddings WHERE vec_id <> 7 AND {where} ORDER BY {d}, vec_id LIMIT 5"


@query(_recommend_sql("true"))
def q12_recommend_similar(spark, sf):
    return _rounded(recommend(table(spark, sf, "embeddings"), 7, 5, None, "vec_id", "embedding")).select("vec_id", "label", "score")


@query(_recommend_sql("label <> (SELECT label FROM embeddings WHERE vec_id = 7)"))
def q13_recommend_cross(spark, sf):
    e = table(spark, sf, "embeddings")
    own = e.filter("vec_id = 7").select("label").first()[0]
    return _rounded(recommend(e, 7, 5, F.col("label") != own, "vec_id", "embedding")).select("vec_id", "label", "score")


@query(f"SELECT vec_id, round(1 - {_dist('embedding', _q(0))}, 6) AS similarity FROM embeddings ORDER BY {_dist('embedding', _q(0))}, vec_id LIMIT 10")
def q14_similarity(spark, sf):
    hits = knn(table(spark, sf, "embeddings"), qv(spark, sf, 0), 10, id_col="vec_id", vector="embedding", columns=["vec_id"])
    return hits.select("vec_id", F.round(F.lit(1.0) - F.col("score"), 6).alias("similarity"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS squared
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def q15_normalize(spark, sf):
    unit = V.normalise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


@query("SELECT vec_id, 128 AS size, 0.0::DOUBLE AS tail_sum, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def q16_pad(spark, sf):
    p = V.pad(F.col("embedding"), 128)
    tail = F.aggregate(F.slice(p, 65, 64), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(p).alias("size"), tail.alias("tail_sum"), F.round(p[0].cast("double"), 6).alias("first"))


# ------------------------------------------------------------------ search

_COLS = ["chunk_id", "file_path", "embedding_type", "score"]


def _two(spark, sf):
    """The query vectors of both sides."""
    found = dict(lookup_vectors(table(spark, sf, "embeddings"), (0, 1), "vec_id", "embedding"))
    return {"code": found[0], "docs": found[1]}


def _search(spark, sf, mode, limit):
    vectors = _two(spark, sf)
    return search.search(chunks_view(spark, sf).select("chunk_id", "file_path", "language", "code", "embedding_type", "vector"), vectors, mode, limit)


def _search_cte(sides: str, k: int) -> str:
    return f"""WITH {_VIEW}, q AS (SELECT vec_id, embedding AS qv FROM embeddings WHERE vec_id IN (0, 1)),
s AS (SELECT c.*, q.vec_id AS side, {_dist('c.vector', 'q.qv')} AS score FROM chunks_view c JOIN q ON {sides}),
t AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score, chunk_id) rn FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score, side, chunk_id) dn FROM t WHERE rn <= {k})"""


_BOTH = "(q.vec_id = 0 AND embedding_type = 'code') OR (q.vec_id = 1 AND embedding_type = 'docs')"
_CODE, _DOCS = "q.vec_id = 0 AND embedding_type = 'code'", "q.vec_id = 1 AND embedding_type = 'docs'"


def _search_sql(sides: str, k: int, tail: str) -> str:
    return f"{_search_cte(sides, k)} SELECT chunk_id, file_path, embedding_type, round(score, 6) AS score FROM u WHERE dn = 1 {tail}"


@query(_search_sql(_CODE, 10, "ORDER BY score, chunk_id LIMIT 10"))
def q17_search_code(spark, sf):
    return _rounded(_search(spark, sf, "code", 10).select(*_COLS))


@query(_search_sql(_DOCS, 10, "ORDER BY score, chunk_id LIMIT 10"))
def q18_search_docs(spark, sf):
    return _rounded(_search(spark, sf, "docs", 10).select(*_COLS))


@query(_search_sql(_BOTH, 10, "ORDER BY score, chunk_id LIMIT 10"))
def q19_search_hybrid(spark, sf):
    return _rounded(_search(spark, sf, "hybrid", 10).select(*_COLS))


@query(_search_sql(_BOTH, 10, ""))
def q20_search_hybrid_nolimit(spark, sf):
    return _rounded(_search(spark, sf, "hybrid", 0).select(*_COLS))


@query(f"{_search_cte(_BOTH, 10)} SELECT (SELECT count(*) FROM t WHERE rn <= 10) AS total_results, least(10, (SELECT count(*) FROM u WHERE dn = 1)) AS returned")
def q21_search_envelope(spark, sf):
    view = chunks_view(spark, sf)
    vectors = _two(spark, sf)
    before = search.hits(view, vectors, "hybrid", 10)
    return search.envelope("first", "hybrid", before, search.search(view, vectors, "hybrid", 10)).select("total_results", "returned")


def _post_sql(where: str) -> str:
    return f"{_search_cte(_BOTH, 10)}, f AS (SELECT * FROM u WHERE dn = 1 ORDER BY score, chunk_id LIMIT 10) SELECT chunk_id, file_path, embedding_type, round(score, 6) AS score FROM f WHERE {where}"


@query(_post_sql("score BETWEEN 0.5 AND 1.5"))
def q22_search_score_band(spark, sf):
    return _rounded(search.post_filters(_search(spark, sf, "hybrid", 10), score_band=(0.5, 1.5)).select(*_COLS))


@query(_post_sql("language = 'en'"))
def q23_search_language(spark, sf):
    return _rounded(search.post_filters(_search(spark, sf, "hybrid", 10), language="en").select(*_COLS))


@query(_post_sql("contains(file_path, 'issue')"))
def q24_search_path(spark, sf):
    return _rounded(search.post_filters(_search(spark, sf, "hybrid", 10), path_contains="issue").select(*_COLS))


@query(_post_sql("file_path GLOB '[ir]*/*[0-8].txt'"))
def q71_search_glob(spark, sf):
    return _rounded(search.post_filters(_search(spark, sf, "hybrid", 10), path_glob="[ir]*/*[0-8].txt").select(*_COLS))


def _full_search(spark, sf):
    view, vectors = chunks_view(spark, sf).drop("n_chars", "label"), _two(spark, sf)
    return search.hits(view, vectors, "hybrid", 10), search.search(view, vectors, "hybrid", 10)


_TOTALS = "(SELECT count(*) FROM t WHERE rn <= 10)::BIGINT AS total_results, least(10, (SELECT count(*) FROM u WHERE dn = 1))::BIGINT AS returned"
_RESULT = """SELECT chunk_id, coalesce(file_path, '') AS file_path, 0 AS line_start, 0 AS line_end, coalesce(language, '') AS language, coalesce(code, '') AS code, round(score, 6) + 0.0 AS score, embedding_type
FROM u WHERE dn = 1 ORDER BY u.score, chunk_id LIMIT 10"""


@query(f"{_search_cte(_BOTH, 10)}, r AS ({_RESULT}) SELECT 'first' AS query, 'hybrid' AS mode, {_TOTALS}, r.* FROM r")
def q66_envelope_results(spark, sf):
    before, got = _full_search(spark, sf)
    env = search.envelope("first", "hybrid", before, got)
    rows = env.select("query", "mode", "total_results", "returned", F.explode("results").alias("r")).select("query", "mode", "total_results", "returned", "r.*")
    return _rounded(rows.drop("chunk_type", "heading", "heading_level", "parent_heading"))


@query(f"""{_search_cte(_BOTH, 10)}, r AS ({_RESULT}) SELECT 'hybrid' AS mode, {_TOTALS}, (SELECT count(*) FROM r)::INT AS n_results, (SELECT arg_min(chunk_id, (score, chunk_id)) FROM r)::VARCHAR AS first_id,
(SELECT arg_min(code, (score, chunk_id)) FROM r) AS first_code, (SELECT arg_min(embedding_type, (score, chunk_id)) FROM r) AS first_side, NULL::VARCHAR AS first_heading""")
def q67_search_json(spark, sf):
    text = search.to_json(search.envelope("first", "hybrid", *_full_search(spark, sf)))
    part = lambda p: F.get_json_object("json", p)
    return text.select(
        part("$.mode").alias("mode"), part("$.total_results").cast("long").alias("total_results"), part("$.returned").cast("long").alias("returned"), F.json_array_length(part("$.results")).alias("n_results"),
        part("$.results[0].chunk_id").alias("first_id"), part("$.results[0].code").alias("first_code"), part("$.results[0].embedding_type").alias("first_side"), part("$.results[0].heading").alias("first_heading"),
    )


@query(f"""{_search_cte(_BOTH, 10)}, r AS ({_RESULT}) SELECT file_path || ':0-0  score ' || printf('%.4f', score) || chr(10) || '    ' || substr(code, 1, 100) AS line FROM r""")
def q68_search_text(spark, sf):
    return search.to_text(_full_search(spark, sf)[1])


# ------------------------------------------------------------------ projections, predicates, counts


@query("SELECT * FROM supplier")
def q25_select_all_cols(spark, sf):
    return table(spark, sf, "supplier")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q26_select_columns(spark, sf):
    return QuerySpec(columns=("o_orderkey", "o_orderstatus", "o_totalprice")).apply(table(spark, sf, "orders"))


for _name, _where in (
    ("q27_filter_range", "p_retailprice < 1000 AND p_size >= 40"), ("q28_filter_between", "p_retailprice BETWEEN 900 AND 950"),
    ("q29_filter_in", "p_brand IN ('Brand#11', 'Brand#23')"), ("q30_filter_like", "p_name LIKE '%e%'"),
    ("q31_filter_and_or", "(p_size > 10 AND p_size < 20) OR p_brand = 'Brand#11'"), ("q32_filter_neq", "p_brand != 'Brand#11'"),
    ("q33_filter_bool", "(p_size > 25) = true"),
):
    QUERIES[_name] = lambda spark, sf, w=_where: QuerySpec(columns=("p_partkey", "p_name", "p_brand", "p_size"), where=w).apply(table(spark, sf, "part"))
    SQL[_name] = f"SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE {_where}"


@query("SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE n_chars > 500) AS n_long, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts")
def q34_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("n_long"), F.count("text").alias("n_texts"))


@query("SELECT language, chunk_type, count(*) AS n FROM code_chunks GROUP BY ALL")
def q35_count_by_lang(spark, sf):
    return table(spark, sf, "code_chunks").groupBy("language", "chunk_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (embedding_type = 'code') AS n_code, count(*) FILTER (embedding_type = 'docs') AS n_docs, count(DISTINCT file_path) AS n_files, max(indexed_at) AS last_indexed FROM code_chunks")
def q36_count_split(spark, sf):
    return table(spark, sf, "code_chunks").agg(
        F.count_if(F.col("embedding_type") == "code").alias("n_code"), F.count_if(F.col("embedding_type") == "docs").alias("n_docs"),
        F.countDistinct("file_path").alias("n_files"), F.max("indexed_at").alias("last_indexed"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def q37_page_offset(spark, sf):
    return dml.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, 100)


# ------------------------------------------------------------------ changes


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 99 ELSE p_size END AS p_size, p_brand FROM part")
def q38_update(spark, sf):
    return dml.update(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), F.col("p_brand") == "Brand#11", {"p_size": 99})


@query("""SELECT p_partkey, CASE WHEN s2 > 40 THEN s2 + 1 ELSE s2 END AS p_size FROM (SELECT p_partkey, CASE WHEN s1 BETWEEN 10 AND 20 THEN 50 ELSE s1 END AS s2
FROM (SELECT p_partkey, CASE WHEN p_size < 5 THEN 15 ELSE p_size END AS s1 FROM part))""")
def q39_update_ranges(spark, sf):
    steps = [("p_size < 5", {"p_size": 15}), ("p_size BETWEEN 10 AND 20", {"p_size": 50}), ("p_size > 40", {"p_size": F.expr("p_size + 1")})]
    return dml.update_all(table(spark, sf, "part").select("p_partkey", "p_size"), steps)


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25 OR p_brand = 'Brand#11')")
def q40_delete(spark, sf):
    return dml.delete(table(spark, sf, "part"), "p_size > 25 OR p_brand = 'Brand#11'").select("p_partkey", "p_size")


@query("""SELECT coalesce(sum(n), 0)::BIGINT AS total_rows, count(*) AS unique_rows, (coalesce(sum(n), 0) - count(*))::BIGINT AS duplicate_rows
FROM (SELECT sha256(code) AS h, count(*) AS n FROM code_chunks WHERE code IS NOT NULL GROUP BY 1)""")
def q41_hash_dedup(spark, sf):
    return embed.dedup_stats(table(spark, sf, "code_chunks"))


@query("""SELECT doc_id, (strlen(text) + 1)::DOUBLE AS bytes, (coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::BIGINT)), 0) + 1)::DOUBLE AS points
FROM documents WHERE text IS NOT NULL""")
def q42_fake_embed(spark, sf):
    v = embed.length_vector(F.col("text"), 1)
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", v[0].cast("double").alias("bytes"), v[1].cast("double").alias("points"))


# ------------------------------------------------------------------ chunks of text


def _files(spark, sf, ext):
    return table(spark, sf, "source_files").filter(F.col("path").endswith(ext))


@query("SELECT path AS file_path, 1 AS line_start, strlen(content)::INT AS line_end, content AS code, regexp_extract(path, '[^/]*$') AS name FROM source_files WHERE content IS NOT NULL AND (path LIKE '%.txt' OR path LIKE '%.rst')")
def q43_chunk_whole(spark, sf):
    files = table(spark, sf, "source_files").filter("path LIKE '%.txt' OR path LIKE '%.rst'")
    return chunk_text.chunk_whole(files).select("file_path", "line_start", "line_end", "code", "name")


def _lines_cte(source: str, where: str) -> str:
    return rf"""files AS (SELECT {source}), arrs AS (SELECT path, regexp_split_to_array(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS a FROM files WHERE content IS NOT NULL AND content <> '' AND {where}),
lines AS (SELECT path, unnest(range(1, len(a) + 1))::INT AS ln, unnest(a) AS line FROM arrs)"""


@query(rf"""WITH {_lines_cte('doc_id::VARCHAR AS path, text AS content FROM documents', 'true')},
m AS (SELECT *, regexp_replace(line, '[\s\x0B]+', '', 'g') = '' AS blank FROM lines), g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY path ORDER BY ln) AS run FROM m)
SELECT path AS file_path, min(ln)::INT AS line_start, max(ln)::INT AS line_end, string_agg(line, chr(10) ORDER BY ln) AS code FROM g WHERE NOT blank GROUP BY path, run""")
def q44_chunk_blank(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunk_text.chunk_blank_lines(docs)


_HEAD = r"'(?s)^(#{1,6})\s+(.+)$'"
_MD = rf"""{_lines_cte('path, content FROM source_files', "path LIKE '%.md'")},
h AS (SELECT path, ln, line, regexp_matches(line, {_HEAD}) AS head FROM lines),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY ln) AS sec, CASE WHEN head THEN length(regexp_extract(line, {_HEAD}, 1)) END AS lvl,
  CASE WHEN head THEN trim(regexp_extract(line, {_HEAD}, 2), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) END AS txt FROM h),
sections AS (SELECT path, sec, min(ln)::INT AS line_start, max(ln)::INT AS line_end, string_agg(line, chr(10) ORDER BY ln) AS code, max(lvl) AS lvl, max(txt) AS txt FROM s GROUP BY path, sec),
heads AS (SELECT path, line_start, lvl, txt, row_number() OVER (PARTITION BY path ORDER BY line_start) AS k FROM sections WHERE lvl IS NOT NULL),
walk AS (SELECT path, line_start, lvl, txt, k, []::VARCHAR[] AS st FROM heads WHERE k = 1
  UNION ALL SELECT h.path, h.line_start, h.lvl, h.txt, h.k, CASE WHEN h.lvl = 1 THEN [] WHEN h.lvl > w.lvl THEN CASE WHEN w.txt <> '' THEN list_append(w.st, w.txt) ELSE w.st END ELSE w.st[1:greatest(h.lvl - 2, 0)] END
  FROM walk w JOIN heads h ON h.path = w.path AND h.k = w.k + 1)"""


@query(f"""WITH RECURSIVE {_MD} SELECT s.path AS file_path, s.line_start, s.line_end, s.code,
CASE WHEN count(*) OVER (PARTITION BY s.path) = 1 AND coalesce(s.txt, '') = '' THEN 'document' WHEN coalesce(s.txt, '') = '' THEN 'content' ELSE 'section' END AS chunk_type,
CASE WHEN count(*) OVER (PARTITION BY s.path) = 1 AND coalesce(s.txt, '') = '' THEN regexp_extract(s.path, '[^/]*$') ELSE coalesce(s.txt, '') END AS heading,
CASE WHEN coalesce(s.txt, '') = '' THEN '' ELSE s.lvl::VARCHAR END AS heading_level FROM sections s""")
def q45_chunk_markdown(spark, sf):
    return chunk_text.chunk_markdown(_files(spark, sf, ".md")).select("file_path", "line_start", "line_end", "code", "chunk_type", "heading", "heading_level")


@query(f"WITH RECURSIVE {_MD} SELECT path AS file_path, line_start, array_to_string(st, ' > ') AS parent_heading FROM walk")
def q46_parent_heading(spark, sf):
    out = chunk_text.chunk_markdown(_files(spark, sf, ".md"))
    return out.filter("code rlike '(?s)^#{1,6}\\\\s+.' and chunk_type <> 'content'").select("file_path", "line_start", "parent_heading")


# ------------------------------------------------------------------ languages


def _sql_any(parts: tuple[str, ...], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_CPP, _CC = _sql_any(L.CPP_MARKERS, "t"), _sql_any(L.C_MARKERS, "t")
_EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
_DETECT = f"CASE WHEN e = '.c' THEN CASE WHEN {_CPP} THEN 'cpp' ELSE 'c' END WHEN e = '.h' THEN CASE WHEN {_CC} AND NOT {_CPP} THEN 'c' ELSE 'cpp' END " + " ".join(
    f"WHEN e = '{e}' THEN '{n}'" for e, n in L.FULL.items()
) + " ELSE 'unknown' END"


@query(f"SELECT path, {_DETECT} AS language FROM (SELECT path, coalesce(content, '') AS t, {_EXT} AS e FROM source_files)")
def q47_detect_language(spark, sf):
    return table(spark, sf, "source_files").select("path", L.detect_language(F.col("path"), F.col("content")).alias("language"))


@query(f"SELECT path, {_CPP} AS cpp, {_CC} AND NOT {_CPP} AS only_c FROM (SELECT path, content AS t FROM source_files WHERE content IS NOT NULL)")
def q48_cpp_markers(spark, sf):
    files = table(spark, sf, "source_files").filter("content IS NOT NULL")
    return files.select("path", L.has_cpp_markers(F.col("content")).alias("cpp"), L.only_c_markers(F.col("content")).alias("only_c"))


_STRICT = "CASE e " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in L.STRICT.items()) + " END"


@query(rf"""SELECT path, {_STRICT} AS language FROM (SELECT DISTINCT path, regexp_extract(path, '(\.[^./]*)$', 1) AS e FROM file_listing WHERE path IS NOT NULL)
WHERE {_STRICT} IS NOT NULL AND NOT regexp_matches(path, '(^|/)\.')""")
def q49_ext_map(spark, sf):
    paths = table(spark, sf, "file_listing").filter("path IS NOT NULL").select("path").distinct()
    out = paths.withColumn("language", L.scanner_language(F.col("path"))).filter(F.col("language").isNotNull())
    return out.filter(~L.is_hidden(F.col("path")))


# ------------------------------------------------------------------ incremental runs

_CUT = "2025-06-01 00:00:00"
_PLAN = f"""scan AS (SELECT path, max(mod_time) AS now_t, true AS seen FROM file_listing WHERE path IS NOT NULL AND listed_at >= TIMESTAMPTZ '{_CUT}+00' GROUP BY path),
stored AS (SELECT path, max(mod_time) AS was_t, true AS known FROM file_listing WHERE path IS NOT NULL AND listed_at < TIMESTAMPTZ '{_CUT}+00' GROUP BY path),
actions AS (SELECT coalesce(scan.path, stored.path) AS path, CASE WHEN seen IS NULL THEN 'deleted' WHEN known IS NULL THEN 'new'
  WHEN (was_t IS NULL AND now_t IS NOT NULL) OR now_t > was_t THEN 'modified' ELSE 'unchanged' END AS action FROM scan FULL JOIN stored ON scan.path = stored.path)"""


def _actions(spark, sf):
    listing, cut = table(spark, sf, "file_listing"), F.lit(_CUT).cast("timestamp")
    return incremental.plan(listing.filter(F.col("listed_at") >= cut), listing.filter(F.col("listed_at") < cut))


@query(f"WITH {_PLAN} SELECT path, action FROM actions")
def q50_incremental_plan(spark, sf):
    return _actions(spark, sf)


@query(f"""WITH {_PLAN}, old AS (SELECT chunk_id, file_path FROM code_chunks WHERE indexed_at < TIMESTAMPTZ '{_CUT}+00'),
kept AS (SELECT * FROM old WHERE file_path NOT IN (SELECT path FROM actions WHERE action IN ('modified', 'deleted'))),
fresh AS (SELECT chunk_id, file_path FROM code_chunks WHERE file_path IN (SELECT path FROM actions WHERE action IN ('new', 'modified')))
SELECT * FROM kept UNION ALL SELECT * FROM fresh""")
def q51_upsert(spark, sf):
    chunks, actions = table(spark, sf, "code_chunks").select("chunk_id", "file_path", "indexed_at"), _actions(spark, sf)
    old = chunks.filter(F.col("indexed_at") < F.lit(_CUT).cast("timestamp")).select("chunk_id", "file_path")
    todo = actions.filter(F.col("action").isin("new", "modified")).select(F.col("path").alias("file_path"))
    fresh = chunks.select("chunk_id", "file_path").join(todo, "file_path", "left_semi")
    return incremental.upsert(old, fresh, actions)


@query("""SELECT repo, path, language, mod_time FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(mod_time, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC,
coalesce(listed_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(language, '') DESC) AS rn FROM file_listing WHERE path IS NOT NULL) WHERE rn = 1""")
def q53_latest_listing(spark, sf):
    return incremental.latest_listing(table(spark, sf, "file_listing")).select("repo", "path", "language", "mod_time")


@query("""SELECT chunk_id, file_path, code FROM (SELECT *, row_number() OVER (PARTITION BY sha256(code) ORDER BY chunk_id, file_path) AS rn FROM code_chunks WHERE code IS NOT NULL) WHERE rn = 1""")
def q54_dedup_by_text(spark, sf):
    chunks = table(spark, sf, "code_chunks").filter("code IS NOT NULL").select("chunk_id", "file_path", "code")
    order = Window.partitionBy(X.content_hash(F.col("code"))).orderBy("chunk_id", "file_path")
    return chunks.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


@query("""SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'name' WHEN p_size IS NULL OR p_size < 10 THEN 'size' END AS first_broken FROM part WHERE p_name IS NULL OR p_name = '' OR p_size IS NULL OR p_size < 10""")
def q55_validate(spark, sf):
    _, bad = dml.validated(table(spark, sf, "part"), {"name": F.col("p_name") != "", "size": F.col("p_size") >= 10})
    return bad.select("p_partkey", F.col("broken_rules")[0].alias("first_broken"))


@query("SELECT vec_id, (list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0) AS has_length, len(embedding)::INT AS dim FROM embedding_data WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def q56_vector_quality(spark, sf):
    v = F.col("embedding")
    ok = table(spark, sf, "embedding_data").filter((F.size(v) == 96) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return ok.select("vec_id", (V.norm(v) > 0).alias("has_length"), F.size(v).alias("dim"))


# ------------------------------------------------------------------ approximate search, full text, code chunks


def _ann(spark, sf, kind):
    e = table(spark, sf, "embeddings")
    return ann.Index(spark, stored(e, kind, lambda path: ann.build(e, path, kind)))


def _ann_hits(spark, sf, kind):
    return _rounded(_ann(spark, sf, kind).search(qv(spark, sf, 0)).select(F.col("id").alias("vec_id"), "score"))


@query()
def q52_ann_lsh(spark, sf):
    return _ann_hits(spark, sf, "lsh")


@query()
def q57_ann_ivf_flat(spark, sf):
    return _ann_hits(spark, sf, "ivf_flat")


@query()
def q58_ann_ivf_pq(spark, sf):
    return _ann_hits(spark, sf, "ivf_pq")


def _ann_recalls(spark, sf):
    """(kind, n_exact, n_found, recall) of the stored indexes for all vectors whose id is divisible by 100."""
    queries = table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = _ann(spark, sf, "ivf_flat")
    truth = materialise(exact.search(queries, width=ann.MOST_CELLS), "ann-exact")  # every cell
    out = None
    for kind in ann.KINDS:
        row = ann.recall(_ann(spark, sf, kind).search(queries), truth).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def q63_ann_recall(spark, sf):
    return _ann_recalls(spark, sf)


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
h AS (SELECT query_id, e.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_dist('e.embedding', 'q.qv')}, e.vec_id) AS rn FROM embeddings e CROSS JOIN q)
SELECT kind, (SELECT count(*) FROM h WHERE rn <= 10)::BIGINT AS n_exact, true AS enough FROM (VALUES ('ivf_flat'), ('ivf_pq'), ('lsh')) t(kind)""")
def q64_ann_recall_enough(spark, sf):
    return _ann_recalls(spark, sf).select("kind", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query(f"""SELECT query_id, vec_id, round(score, 6) AS score, rn AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_dist('e.embedding', 'q.embedding')} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_dist('e.embedding', 'q.embedding')}, e.vec_id) AS rn FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rn <= 10""")
def q65_ann_all_cells(spark, sf):
    """The stored index with every cell visited is an exact search."""
    queries = table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return _rounded(_ann(spark, sf, "ivf_flat").search(queries, width=ann.MOST_CELLS).select("query_id", F.col("id").alias("vec_id"), "score", "rank"))


_TERMS = ("index", "batch", "vector")
_TF = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
_BM = " + ".join(f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(3))


@query(f"""WITH r AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, len(words) AS size, {_TF} FROM r), t AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1, count(*) FILTER (tf2 > 0) AS df2 FROM s)
SELECT id, round({_BM}, 6) AS score FROM s, t WHERE {_BM} > 0 ORDER BY {_BM} DESC, id LIMIT 20""")
def q59_bm25(spark, sf):
    docs = table(spark, sf, "documents")
    path = stored(docs, "fulltext", lambda to: fulltext.build(docs, to, "doc_id", "text"))
    return _rounded(fulltext.search(spark, path, _TERMS))


@query("SELECT path FROM source_files WHERE list_contains(string_split(path, '/'), 'internal')")
def q60_label_list(spark, sf):
    return table(spark, sf, "source_files").filter(F.array_contains(F.split("path", "/"), "internal")).select("path")


@query("SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n FROM (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY ALL) GROUP BY term")
def q61_inverted_index(spark, sf):
    return fulltext.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query()
def q62_chunk_code(spark, sf):
    """Functions, methods and types of every source file."""
    files = table(spark, sf, "source_files").withColumn("language", L.detect_language(F.col("path"), F.col("content")))
    return chunk_code.chunk_code(files).select("file_path", "language", "chunk_type", "name", "signature", "receiver", "line_start", "line_end")


@query(rf"""WITH {_lines_cte('path, content FROM source_files', "path LIKE '%.go'")},
f AS (SELECT path, ln, line, regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*[\[(]', 1) AS name FROM lines)
SELECT path AS file_path, name, ln AS line_start, CASE WHEN line LIKE 'func (%' THEN 'method' ELSE 'function' END AS chunk_type FROM f WHERE name <> ''""")
def q69_go_functions(spark, sf):
    files = _files(spark, sf, ".go").select("path", F.lit("go").alias("language"), "content")
    return chunk_code.chunk_code(files).filter("chunk_type IN ('function', 'method')").select("file_path", "name", "line_start", "chunk_type")


@query(rf"""WITH {_lines_cte('path, content FROM source_files', "path LIKE '%.py'")},
f AS (SELECT path, ln, regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)\s*[(\[]', 1) AS name FROM lines)
SELECT path AS file_path, name, ln AS line_start FROM f WHERE name <> ''""")
def q70_python_functions(spark, sf):
    files = _files(spark, sf, ".py").select("path", F.lit("python").alias("language"), "content")
    return chunk_code.chunk_code(files).filter("chunk_type IN ('function', 'method')").select("file_path", "name", "line_start")
