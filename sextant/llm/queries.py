"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import credentials, doc_pairs, mixing, origin, packing, parse_check, pii, similar, splitting, tokens
from sextant.session import materialise, read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.found(read_table(spark, sf, "code_chunks"))


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that held a credential, with their redacted text."""
    out = credentials.redact(read_table(spark, sf, "code_chunks").select("chunk_id", "file_path", "code"))
    return out.filter("n_credentials > 0").select("chunk_id", "n_credentials", "code_redacted").distinct()


def p1_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    spans = credentials.find_spans(read_table(spark, sf, "code_chunks"))
    return spans.distinct().groupBy("rule").agg(F.count("*").alias("n_spans"), F.countDistinct("chunk_id").alias("n_chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return origin.foreign_files(read_table(spark, sf, "source_files"))


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each file that was not written by hand counts as such, with its statistics."""
    out = origin.reasons(origin.file_stats(read_table(spark, sf, "source_files"))).filter("foreign")
    return out.select("path", "lang", "vendored", "generated", "minified", "data_only", "max_line", "mean_line", "space_share", "numeric_density", "encoded_share", "numbered_share")


def p2_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many files each reason gives, and how many it gives alone: the layout's (generated, minified, data) and those of third-party copies."""
    out = origin.reasons(origin.file_stats(read_table(spark, sf, "source_files"))).filter("foreign")
    why = {"generated": "generated", "minified": "minified", "data_only": "data_only", "folder": "folder", "owner": "owner"}
    held = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in why.items()]), lambda x: x.isNotNull())
    rows = out.select("lang", F.explode(held).alias("reason"), (F.size(held) == 1).alias("alone"))
    return rows.groupBy("lang", "reason").agg(F.count("*").alias("n_files"), F.count_if("alone").alias("n_alone"))


def p2_hand_written(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of hand-written files."""
    return origin.hand_written(read_table(spark, sf, "file_listing"), read_table(spark, sf, "source_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_check.syntax_report(read_table(spark, sf, "source_files")).filter("not valid").select("path").distinct()


def p4_first_faults(spark: SparkSession, sf: str) -> DataFrame:
    return parse_check.syntax_report(read_table(spark, sf, "source_files")).filter("not valid").select("path", "lang", "fault_line", "fault")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    report = parse_check.syntax_report(read_table(spark, sf, "source_files"))
    return parse_check.fault_rates(report, read_table(spark, sf, "file_listing"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return doc_pairs.documented_functions(read_table(spark, sf, "source_files")).select("path", "fn_name", "line_start").distinct()


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Description and code with signature of each documented function."""
    return doc_pairs.documented_functions(read_table(spark, sf, "source_files"))


def p5_link_places(spark: SparkSession, sf: str) -> DataFrame:
    """How many comments were linked from where, per language: beyond those that stand where documentation should."""
    links = doc_pairs.linked_functions(read_table(spark, sf, "source_files")).distinct()
    return links.groupBy("lang", "place").agg(F.count("*").alias("n_links"), F.countDistinct("path").alias("n_files"))


def _tiers(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    rows = read_table(spark, sf, "size_profiles").filter("unit = 'tokens' and profile like 'pack%'").select("profile", "capacity").collect()
    return [(r[0], int(r[1])) for r in rows]


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Each text (or piece of an oversized one) with its container: short texts fill the gaps of long containers."""
    sizes = tokens.token_counts(read_table(spark, sf, "documents").select("doc_id", "text"))
    return packing.pack(sizes, _tiers(spark, sf))


def p7_packing_by_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """A whole packing of all texts for each capacity."""
    sizes = materialise(tokens.token_counts(read_table(spark, sf, "documents").select("doc_id", "text")), "sizes")
    return packing.pack_each(sizes, _tiers(spark, sf))


def p7_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return packing.utilisation(p7_packing(spark, sf))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf, "documents").select("doc_id", "source", "text"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), read_table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What each target got, which source limits the mixture and how much text is left unused."""
    sizes, targets = materialise(_sizes(spark, sf), "mixing-sizes"), read_table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), targets, sizes)


def p8_on_target(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every source with text has its share within one block, and none is repeated too often."""
    sizes, targets = materialise(_sizes(spark, sf), "mixing-sizes"), read_table(spark, sf, "mix_targets")
    return mixing.on_target(mixing.mix(sizes, targets), targets, sizes)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(read_table(spark, sf, "documents"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.redact(read_table(spark, sf, "documents"))


#: Share of the sample's true links of at least 0.8 that visited leaves must hold.
LINK_RECALL = 0.998
#: Share of the ten nearest neighbours of any similarity that visited leaves must hold, where every vector is a query.
GRAPH_RECALL = 0.9


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_pairs(similar.usable_vectors(read_table(spark, sf, "embedding_data")), recall=LINK_RECALL)


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100, scored by squared distance at unit length."""
    hits = similar.search(similar.usable_vectors(read_table(spark, sf, "embedding_data")))
    return hits.select(F.col("a").alias("query_id"), F.col("rank").alias("result_no"), F.col("b").alias("hit_vec_id"), F.round(F.lit(2.0) - 2 * F.col("sim"), 6).alias("score"))


def p3_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar other vectors of every usable vector, scored by squared distance at unit length."""
    hits = similar.neighbour_graph(similar.usable_vectors(read_table(spark, sf, "embedding_data")), recall=GRAPH_RECALL)
    return hits.select(F.col("a").alias("query_id"), F.col("rank").alias("result_no"), F.col("b").alias("hit_vec_id"), F.round(F.lit(2.0) - 2 * F.col("sim"), 6).alias("score"))


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What the index loses against an exact search of the same queries."""
    vectors = similar.usable_vectors(read_table(spark, sf, "embedding_data"))
    return similar.loss(similar.search(vectors), similar.search(vectors, exact=True))


def p3_usable(spark: SparkSession, sf: str) -> DataFrame:
    return similar.usable_vectors(read_table(spark, sf, "embedding_data")).select("vec_id").distinct()


def _profile(spark: SparkSession, sf: str, name: str) -> tuple[int, int]:
    row = read_table(spark, sf, "size_profiles").filter(F.col("profile") == name).select("capacity", "overlap").first()
    return int(row[0]), int(row[1])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    capacity, overlap = _profile(spark, sf, "chunk_split")
    return splitting.split_oversized(read_table(spark, sf, "code_chunks"), capacity, overlap).select(F.col("id").alias("chunk_id")).distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    capacity, overlap = _profile(spark, sf, "chunk_split")
    out = splitting.split_oversized(read_table(spark, sf, "code_chunks"), capacity, overlap)
    return out.select(F.col("id").alias("chunk_id"), F.col("path").alias("file_path"), "piece_no", "line_start", "line_end", "char_start", "char_end", "piece")


def p9_learnt_share(spark: SparkSession, sf: str) -> DataFrame:
    """How many findings of each type an empty model would give: what goes by form, and what is learnt."""
    docs = read_table(spark, sf, "documents")
    alone = materialise(pii.by_form_alone(docs), "pii-alone").groupBy("pii_type").agg(F.count("*").alias("n_by_form"))
    out = materialise(pii.found(docs), "pii-found").groupBy("pii_type").agg(F.count("*").alias("n_found")).join(alone, "pii_type", "left")
    return out.select("pii_type", "n_found", F.coalesce("n_by_form", F.lit(0)).alias("n_by_form"), F.round(1 - F.coalesce("n_by_form", F.lit(0)) / F.col("n_found"), 6).alias("learnt_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_redacted, p1_rule_counts, p2_found, p2_reasons, p2_reason_counts, p2_hand_written, p3_found, p3_neighbours, p3_graph, p3_recall, p3_usable, p4_found, p4_first_faults, p4_rates, p5_found, p5_pairs, p5_link_places, p6_found, p6_pieces, p7_packing, p7_packing_by_capacity, p7_utilisation, p8_mixture, p8_shares, p8_on_target, p9_found, p9_redacted, p9_learnt_share)
}
SQL: dict[str, str] = {
    "p3_usable": """
        SELECT DISTINCT vec_id FROM embedding_data
        WHERE vec_id IS NOT NULL AND len(embedding) = 96
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p6_found": """
        SELECT DISTINCT chunk_id FROM code_chunks
        WHERE chunk_id IS NOT NULL AND length(code) > (SELECT capacity FROM size_profiles WHERE profile = 'chunk_split')""",
    "p8_on_target": r"""
        WITH d AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g') AS source FROM documents WHERE text <> '' AND doc_id IS NOT NULL),
        t AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g') AS source FROM mix_targets WHERE source IS NOT NULL)
        SELECT source, source IN (SELECT source FROM d WHERE source IS NOT NULL) AS has_text, true AS on_target, true AS within_repeats FROM t""",
}
