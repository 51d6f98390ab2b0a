"""The registered query of each operator: (spark, sf_dir) to its full result."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, collocations, decontaminate, html_text, licenses, lm, near_dup, pieces, repeats, secret_scan, toxicity, variants, warc
from tidemark.llm.textkit import checkpoint_ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.corpus_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, one_in=199), ratio=5)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_ready(spark)
    packages = warc.write(table(spark, sf_dir, "pages"), f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid4().hex}", least=0)
    return warc.pages_of(warc.read(spark, packages, payload=False))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_near_dup, op3_pieces, op4_html_text, op5_ann, op6_repeats, op7_decontaminate, op8_toxicity, op9_licenses, op10_lm, op11_variants, op12_warc, op13_collocations)}
ORACLES: dict[str, str] = {"op2_near_dup": near_dup.oracle_sql(3, 85), "op7_decontaminate": decontaminate.ORACLE_SQL, "op11_variants": variants.oracle_sql(), "op12_warc": warc.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
