"""Queries of the problems that this package solves, and SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.bin_packing import pack_texts
from arcweave.llm.canonical import class_members, same_look_pairs
from arcweave.llm.heavy_hitters import frequent_values
from arcweave.llm.leaks import find_leaks
from arcweave.llm.top_n import top_n_per_group

RELATIONS = ("relation_acct_item", "relation_item_site")
SHARE = 100  # p3: a value counts if it stands in more than 1 of so many rows
TOP_N = 5  # p1
MIN_WORDS = 12  # p8
EXCHANGED = 2  # p8_similar_passages


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    order = [("ts", "desc"), ("arr_value", "asc"), ("pos", "asc")]
    return top_n_per_group(_table(spark, sf, "concat_to_arr"), ["arr_index"], order, TOP_N).select("pos")


def p1_top_entries(spark: SparkSession, sf: str) -> DataFrame:
    order = [("ts", "desc"), ("arr_value", "asc"), ("pos", "asc")]
    return top_n_per_group(_table(spark, sf, "concat_to_arr"), ["arr_index"], order, TOP_N)


def _frequent(spark: SparkSession, sf: str, k: int) -> DataFrame:
    out = None
    for rel in RELATIONS:
        df = _table(spark, sf, rel)
        rows = frequent_values(df, ["from_key", "to_key"], k)
        rows = rows.select(F.lit(rel).alias("rel"), F.regexp_replace("column", "_key$", "").alias("side"), F.col("value").alias("node_key"), "cnt", "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    # fewer than SHARE values can have such a share, so heaps of that size lose none
    found = _frequent(spark, sf, SHARE)
    return found.filter(F.col("cnt") * SHARE > F.col("n_rows")).select("rel", "side", "node_key")


def p3_top_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _frequent(spark, sf, 20)


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_texts(_table(spark, sf, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf: str, **how) -> DataFrame:
    return find_leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "benchmark"), "item_id", "text", MIN_WORDS, EXCHANGED, **how)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).filter(F.col("exact_words") >= MIN_WORDS).select("doc_id", "item_id").distinct()


def p8_found_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same in the way that is taken for test sets too large to be sent to all tasks."""
    return _leaks(spark, sf, broadcast_seeds=0).filter(F.col("exact_words") >= MIN_WORDS).select("doc_id", "item_id").distinct()


def p8_similar_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps in which up to two words were exchanged."""
    return _leaks(spark, sf).filter(F.col("similar_words") >= MIN_WORDS)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look_pairs(_table(spark, sf, "documents"), "doc_id", "text")


def p9_look_classes(spark: SparkSession, sf: str) -> DataFrame:
    return class_members(_table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_top_entries, p3_found, p3_top_keys, p7_containers, p8_found, p8_found_joined, p8_similar_passages, p9_found, p9_look_classes)
    return {f.__name__: f for f in fs}


# Fixed values for the SQL: written down apart from the tables of the operator, so that each checks the other.
SQL_NOTHING = r"[\x{AD}\x{34F}\x{61C}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"
SQL_SPACES = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
SQL_HYPHENS = r"[\x{2010}\x{2011}\x{58A}\x{1806}\x{FE63}\x{FF0D}]"
SQL_JOINED = "ﬀ ff, ﬁ fi, ﬂ fl, ﬃ ffi, ﬄ ffl, ﬅ ſt, ﬆ st, ĳ ij, Ĳ IJ, Ǆ DŽ, ǅ Dž, ǆ dž, Ǉ LJ, ǈ Lj, ǉ lj, Ǌ NJ, ǋ Nj, ǌ nj, Ǳ DZ, ǲ Dz, ǳ dz"
SQL_LETTERS = {
    "АВЕЅІЈКМНОРСТХҮѴԌԚԜӀ": "ABESIJKMHOPCTXYVGQWI",
    "аеорсухѕіјһѵүԁԛԝӏ": "aeopcyxsijhvydqwl",
    "ЁёЇїЀѐ": "ËëÏïÈè",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹͿ": "ABEZHIKMNOPTYXFCJ",
    "αινορυϲϳ": "aivopucj",
    "ΆΈΊΌΎάίόύϊϋ": "ÁÉÍÓÝáíóúïü",
    "ԼՍՏՕօհյոսցզ": "LUSOohjnugq",
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏒᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPRRSTVWZ",
    "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌⲟⲣⲥ": "BHIKMNOPCTYXZopc",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
}


def _sql_text(column: str) -> str:
    """Canonical text in SQL: character classes by expression, letters by translate, joined letters by replace, NFC."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D)
    out = f"regexp_replace({column}, '{SQL_HYPHENS}', '-', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{SQL_NOTHING}', '', 'g'), '{SQL_SPACES}', ' ', 'g')"
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    for letters, latin in {wide: narrow, "｟｠￠￡￢￣￤￥￦": "⦅⦆¢£¬¯¦¥₩"}.items():
        out = f"translate({out}, '{letters}', '{latin}')"
    out = f"nfc_normalize({out})"
    for letters, latin in SQL_LETTERS.items():
        out = f"translate({out}, '{letters}', '{latin}')"
    for pair in SQL_JOINED.split(", "):
        joined, parts = pair.split()
        out = f"replace({out}, '{joined}', '{parts}')"
    return f"nfc_normalize({out})"


def oracle_sql() -> dict[str, str]:
    place = "row_number() OVER (PARTITION BY arr_index ORDER BY ts DESC, arr_value, pos)"
    sides = " UNION ALL ".join(
        f"SELECT '{rel}' AS rel, '{side}' AS side, {side}_key AS node_key, count(*) AS cnt, (SELECT count(*) FROM {rel}) AS n_rows FROM {rel} GROUP BY {side}_key" for rel in RELATIONS for side in ("from", "to")
    )
    looks = f"SELECT doc_id, text, {_sql_text('text')} AS look FROM documents WHERE text IS NOT NULL"
    words = lambda key, table: f"SELECT {key}, regexp_extract_all(lower({_sql_text('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}"
    grams = lambda key, table, n: f"SELECT {key}, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {table})"
    found = (
        f"WITH dw AS ({words('doc_id', 'documents')}), iw AS ({words('item_id', 'benchmark')}) SELECT DISTINCT doc_id, item_id FROM ({grams('doc_id', 'dw', MIN_WORDS)}) JOIN ({grams('item_id', 'iw', MIN_WORDS)}) USING (g)"
    )
    # 12 words of which two are exchanged have four equal ones in a row; along every diagonal with such a run the equal words
    # are grouped by the number of unequal ones before them, and a similar passage goes from one group to another
    run = -(-(MIN_WORDS - EXCHANGED) // (EXCHANGED + 1))
    similar = (
        f"WITH dw AS ({words('doc_id', 'documents')}), iw AS ({words('item_id', 'benchmark')}),"
        f" c AS (SELECT DISTINCT doc_id, item_id, d.i - b.i AS dg FROM ({grams('doc_id', 'dw', run)}) d JOIN ({grams('item_id', 'iw', run)}) b USING (g)),"
        " cells AS (SELECT doc_id, item_id, dg, unnest(range(greatest(0, -dg), least(len(iw.w), len(dw.w) - dg))) AS q, dw.w AS d, iw.w AS i FROM c JOIN dw USING (doc_id) JOIN iw USING (item_id)),"
        " eq AS (SELECT doc_id, item_id, dg, q, d[q + dg + 1] = i[q + 1] AS same FROM cells),"
        " bad AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id, dg ORDER BY q) AS n FROM eq),"
        " runs AS (SELECT doc_id, item_id, dg, n, min(q) AS q0, max(q) AS q1 FROM bad WHERE same GROUP BY ALL),"
        f" spans AS (SELECT a.*, b.q1 - a.q0 + 1 AS size, b.n - a.n AS wrong, max(b.q1 - a.q0 + 1) OVER (PARTITION BY doc_id, item_id, dg) AS longest FROM runs a JOIN runs b USING (doc_id, item_id, dg) WHERE b.n BETWEEN a.n AND a.n + {EXCHANGED}),"
        f" good AS (SELECT *, max(q1 - q0 + 1) OVER (PARTITION BY doc_id, item_id) AS exact FROM spans WHERE longest >= {MIN_WORDS})"
        " SELECT doc_id, item_id, exact AS exact_words, size AS similar_words, wrong::INTEGER AS substitutions, (q0 + dg)::INTEGER AS doc_word, q0::INTEGER AS item_word FROM good"
        " QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY size DESC, wrong, q0 + dg, q0) = 1"
    )
    return {
        "p1_found": f"SELECT pos FROM (SELECT pos, {place} AS place FROM concat_to_arr) WHERE place <= {TOP_N}",
        "p1_top_entries": f"SELECT pos, arr_index, arr_value, ts FROM (SELECT *, {place} AS place FROM concat_to_arr) WHERE place <= {TOP_N}",
        "p3_found": f"SELECT rel, side, node_key FROM ({sides}) WHERE node_key IS NOT NULL AND cnt * {SHARE} > n_rows",
        "p3_top_keys": f"SELECT rel, side, node_key, cnt, n_rows FROM ({sides}) WHERE node_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel, side ORDER BY cnt DESC, node_key) <= 20",
        "p8_found": found,
        "p8_found_joined": found,
        "p8_similar_passages": similar,
        "p9_found": f"WITH d AS ({looks}) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p9_look_classes": f"WITH d AS ({looks}), c AS (SELECT look, min(doc_id) AS class_id, count(*) AS class_rows, count(DISTINCT text) AS class_forms FROM d GROUP BY look)"
        " SELECT doc_id, class_id, class_rows, class_forms FROM d JOIN c USING (look)",
    }
