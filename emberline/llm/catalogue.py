"""Named queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import collocations, cotrain, decontaminate, imatch, mixing, normsearch, piecebpe, placement, records, roles, sigtree, toxicity, wordpiece
from emberline.llm.common import table
from emberline.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short=True)
    return found.drop("text_hash")


def op2_records(spark: SparkSession, folder: str) -> DataFrame:
    """Encode, write and read back all documents."""
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return records.read_digests(records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    starts, goes_on = wordpiece.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.token_counts(table(spark, folder, "documents"), starts, goes_on)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit_labels(docs, table(spark, folder, "labels")))


def op5_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return cotrain.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_placement(spark: SparkSession, folder: str) -> DataFrame:
    return placement.place(table(spark, folder, "documents").select("doc_id"))


def op7_similar(spark: SparkSession, folder: str) -> DataFrame:
    return sigtree.similar(table(spark, folder, "documents"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return imatch.with_neighbours(docs, imatch.lexicon(docs))


def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_roles(spark: SparkSession, folder: str) -> DataFrame:
    return roles.repaired(table(spark, folder, "conversations"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Encode all documents and decode them again."""
    import public_tokenizers

    return piecebpe.digests(table(spark, folder, "documents"), piecebpe.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return normsearch.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_records": op2_records,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_cotraining": op5_cotraining,
    "op6_placement": op6_placement,
    "op7_similar": op7_similar,
    "op8_fingerprints": op8_fingerprints,
    "op9_mixture": op9_mixture,
    "op10_roles": op10_roles,
    "op11_pieces": op11_pieces,
    "op12_ranked": op12_ranked,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op6_placement": placement.OP6_SQL, "op9_mixture": mixing.OP9_SQL, "op12_ranked": normsearch.OP12_SQL, "op13_collocations": collocations.OP13_SQL}


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(apply_settings(spark), folder)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, query in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
