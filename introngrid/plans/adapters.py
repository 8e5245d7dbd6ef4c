"""Views that turn the test tables into annotation, count and p-value tables.

The texts are valid in Spark SQL and in DuckDB; {table} stands for a test table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from introngrid.storage import gather, spread

TX_EXON = """
SELECT 't' || k AS tx_id, 'g' || g AS gene_id, 'chr' || (g % 5 + 1) AS chrom, CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN g % 2 = 0 THEN rn ELSE n + 1 - rn END AS exon_number, s AS start, s + 150 + (u % 2) * 50 AS stop
FROM (SELECT k, g, rn, n, u, g * 10000 + rn * 1000 + (p % 3) * 100 AS s
      FROM (SELECT l_orderkey AS k, CAST(floor(l_orderkey / 8) AS BIGINT) AS g, l_partkey AS p, l_suppkey AS u,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
                   count(*) OVER (PARTITION BY l_orderkey) AS n FROM {lineitem}) x) y"""
FEATURES = f"""
SELECT tx_id, gene_id, CASE WHEN substr(gene_id, -1) = '7' THEN 'chrM' WHEN substr(gene_id, -1) = '9' THEN 'scaffold' ELSE chrom END AS chrom, strand,
       exon_number, start, stop, 'exon' AS feature,
       CASE substr(gene_id, -1) WHEN '1' THEN 'processed_pseudogene' WHEN '2' THEN 'artifact' WHEN '3' THEN NULL ELSE 'protein_coding' END AS gene_type,
       CASE substr(tx_id, -1) WHEN '1' THEN 'nonsense_mediated_decay' WHEN '2' THEN 'retained_intron' WHEN '3' THEN NULL ELSE 'protein_coding' END AS transcript_type,
       CASE WHEN substr(tx_id, -1) IN ('4', '5') THEN 'R' || gene_id END AS ref_gene_id,
       CASE WHEN substr(tx_id, -1) IN ('4', '5') THEN 'N' || gene_id END AS gene_name
FROM ({TX_EXON}) e"""
QUANT = """
SELECT l_returnflag || l_linestatus AS sample, 't' || l_orderkey AS tx_id, 200 + l_orderkey % 1000 AS effective_length,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS num_reads, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 7 % 1000 + 1 AS tpm
FROM {lineitem} GROUP BY l_returnflag || l_linestatus, l_orderkey"""
CELL_EC = "SELECT user_id AS cell_id, event_id % 40 AS ec_id, count(*) AS n FROM {events} GROUP BY user_id, event_id % 40"
EC_TX = """
SELECT DISTINCT ec_id, tx_id FROM (
    SELECT event_id % 40 AS ec_id, event_id % 40 AS tx_id FROM {events} UNION ALL
    SELECT event_id % 40, (event_id % 40 * 3 + 1) % 40 FROM {events} UNION ALL
    SELECT event_id % 40, (event_id % 40 * 7 + 2) % 40 FROM {events}) x"""
CELL_META = """
SELECT DISTINCT user_id AS cell_id, 'T' || (user_id % 4) AS cell_type, 'C' || (CAST(floor(user_id / 4) AS BIGINT) % 2) AS condition,
       'S' || (CAST(floor(user_id / 4) AS BIGINT) % 12) AS subject FROM {events}"""
PVALS = """
SELECT l_returnflag AS method, 'g' || (l_suppkey % 50) || '.' || (l_linenumber % 3) AS gene_id, l_partkey AS feature_id,
       'L' || l_linenumber AS level_a, 'L' || (l_linenumber + 1 - 2 * (l_partkey % 2)) AS level_b,
       CAST((l_orderkey * 7919 + l_partkey) % 100000 + 1 AS DOUBLE) / CAST(100001 AS DOUBLE) AS p_value, l_tax > 0 AS converged,
       l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
FROM {lineitem}"""
NULL_PVALS = """
SELECT l_returnflag AS method, l_partkey AS test_id,
       CAST((l_orderkey * 104729 + l_suppkey) % 100000 + 1 AS DOUBLE) / CAST(100001 AS DOUBLE) AS p_value,
       CAST((l_orderkey * 31 + l_suppkey) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS statistic,
       l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k4
FROM {lineitem}"""
INTERVALS = "SELECT o_orderpriority AS grp, o_orderkey % 5000 AS start, o_orderkey % 5000 + o_custkey % 40 AS stop, o_orderkey AS id FROM {orders}"

ADAPTERS = {
    "tx_exon": TX_EXON, "features": FEATURES, "quant": QUANT, "cell_ec": CELL_EC, "ec_tx": EC_TX, "cell_meta": CELL_META,
    "pvals": PVALS, "null_pvals": NULL_PVALS, "intervals": INTERVALS,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


#: TX_EXON with its windows over tx_id itself: rows move once for the view and for whatever goes by transcript after it. The key is read from tx_id again behind the move.
EXONS_BY_TX = """
SELECT tx_id, 'g' || g AS gene_id, 'chr' || (g % 5 + 1) AS chrom, CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN g % 2 = 0 THEN rn ELSE n + 1 - rn END AS exon_number, s AS start, s + 150 + (u % 2) * 50 AS stop
FROM (SELECT *, g * 10000 + rn * 1000 + (p % 3) * 100 AS s
      FROM (SELECT *, CAST(floor(CAST(substr(tx_id, 2) AS BIGINT) / 8) AS BIGINT) AS g
            FROM (SELECT tx_id, p, u, row_number() OVER (PARTITION BY tx_id ORDER BY line, p, u) AS rn, count(*) OVER (PARTITION BY tx_id) AS n FROM {rows}) w) x) y"""


def exons_by_transcript(lineitem: DataFrame) -> DataFrame:
    """The rows of TX_EXON, those of a transcript together."""
    rows = lineitem.selectExpr("'t' || l_orderkey AS tx_id", "l_partkey AS p", "l_suppkey AS u", "l_linenumber AS line")
    return lineitem.sparkSession.sql(EXONS_BY_TX, rows=spread(rows, "tx_id"))


QUANT_BY_TX = """
SELECT sample, tx_id, 200 + CAST(substr(tx_id, 2) AS BIGINT) % 1000 AS effective_length, num_reads, num_reads * 7 % 1000 + 1 AS tpm
FROM (SELECT sample, tx_id, CAST(sum(q) AS BIGINT) AS num_reads FROM {rows} GROUP BY sample, tx_id) summed"""


def quant_by_transcript(lineitem: DataFrame) -> DataFrame:
    """The rows of QUANT, those of a transcript together; an order has few rows a sample, so nothing is added up before they move."""
    rows = lineitem.selectExpr("l_returnflag || l_linestatus AS sample", "'t' || l_orderkey AS tx_id", "CAST(l_quantity AS BIGINT) AS q")
    return lineitem.sparkSession.sql(QUANT_BY_TX, rows=gather(rows, "tx_id"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows over the tables of sf_dir."""
    text = ADAPTERS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if text is TX_EXON:
        return exons_by_transcript(tables["lineitem"])
    if text is QUANT:
        return quant_by_transcript(tables["lineitem"])
    return spark.sql(text, **tables)


def sql(text: str) -> str:
    """DuckDB SQL with the adapters that it names by {name} written out as common table expressions."""
    used = [n for n in ADAPTERS if "{" + n + "}" in text]
    bare = {t: t for t in TABLES} | {n: n for n in ADAPTERS}
    for n in bare:
        text = text.replace("{" + n + "}", n)
    heads = []
    for n in used:
        body = ADAPTERS[n]
        for t in TABLES:
            body = body.replace("{" + t + "}", t)
        heads.append(f"{n} AS ({body})")
    if not heads:
        return text
    joined = ", ".join(heads)
    stripped = text.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {joined}, {stripped[14:]}"
    return f"WITH {joined}, {stripped[4:]}" if stripped.upper().startswith("WITH ") else f"WITH {joined} {stripped}"
