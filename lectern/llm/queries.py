"""The operators over the whole given tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, byte_bpe, chats, exact, jaccard, language, mixing, sketches, spelling, substrings, token_files, toxicity, vector_codes
from lectern.llm.data import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), TOKENIZER)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"), PIECES)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("carried.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), TOKENIZER)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op7_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents"))


def op8_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.fingerprints(table(spark, folder, "documents"))


def op9_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chats.chats(table(spark, folder, "conversations"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"), RANKS)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_arrays": op7_suffix_arrays,
    "op8_sketches": op8_sketches,
    "op9_chats": op9_chats,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling": op11_spelling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_vector_codes": op13_vector_codes,
}



def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds of all distances between parts and entries; an assignment is 64 * distance + entry, so that ties go down."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS place, len(embedding) // {parts} AS width,
                list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS numbers
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""pieces AS MATERIALIZED (
            SELECT place, part, numbers[part * width + 1 : (part + 1) * width] AS numbers FROM kept, range({parts}) r(part)
        )""",
        f"book0 AS (SELECT part, place AS entry, numbers FROM pieces WHERE place < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""best{i} AS MATERIALIZED (
                SELECT place, part, min({entries} * CAST(list_sum(list_transform(list_zip(p.numbers, b.numbers),
                    lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + entry) AS best
                FROM pieces p JOIN book{i} b USING (part) GROUP BY place, part
            )"""
        )
        if i < rounds:
            steps.append(
                f"""sums{i} AS (
                    SELECT part, best % {entries} AS entry, axis, count(*) AS n, sum(numbers[axis + 1]) AS total
                    FROM best{i} JOIN pieces USING (place, part), unnest(range(len(numbers))) a(axis) GROUP BY ALL
                ),
                means{i} AS (
                    SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS numbers
                    FROM sums{i} GROUP BY part, entry
                ),
                book{i + 1} AS MATERIALIZED (
                    SELECT part, entry, coalesce(m.numbers, b.numbers) AS numbers
                    FROM book{i} b LEFT JOIN means{i} m USING (part, entry)
                )"""
            )
    steps.append(
        f"""digest AS (
            SELECT sha256(string_agg(array_to_string(numbers, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
        ),
        coded AS MATERIALIZED (
            SELECT place, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code,
                CAST(sum(best // {entries}) AS BIGINT) AS error
            FROM best{rounds} GROUP BY place
        )"""
    )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (place), digest"""


ORACLES: dict[str, str] = {
    "op11_spelling": f"""
        WITH RECURSIVE steps AS (
            SELECT list(list_reduce(list_concat([i], list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
            FROM range(256) r(i)
        ),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run
            FROM documents
        ),
        counted AS MATERIALIZED (
            SELECT head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM runs GROUP BY ALL
        ),
        hashed AS MATERIALIZED (
            SELECT run, n, length(run) AS size, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
                string_split(head || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                    ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))),
                lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1]))) AS h
            FROM counted, steps
        ),
        words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (
                SELECT n, CASE WHEN h % {spelling.ONE_IN} = 0 THEN substring(run, 1, h % size) || substring(run, h % size + 2) ELSE run END AS word
                FROM hashed
            )
            WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_TIMES}
        ),
        holes AS MATERIALIZED (
            SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS hole FROM words, unnest(range(1, length(word) + 1)) p(i)
        ),
        longer AS (SELECT DISTINCT s.word AS short, s.n AS short_n, l.word AS long, l.n AS long_n FROM words s JOIN holes l ON l.hole = s.word),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
            UNION ALL SELECT short, long, long_n FROM longer UNION ALL SELECT long, short, short_n FROM longer
        ),
        best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM near GROUP BY word),
        forms AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best[1] >= 2 * w.n THEN b.best[2] END AS form,
                CASE WHEN -b.best[1] >= 2 * w.n THEN -b.best[1] END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ),
        ways AS (
            SELECT word, word AS root, form AS onwards FROM forms
            UNION ALL
            SELECT w.word, f.word, f.form FROM ways w JOIN forms f ON f.word = w.onwards
        )
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
        FROM forms f JOIN ways w ON w.word = f.word AND w.onwards IS NULL
    """,
    "op13_vector_codes": _codes_sql(),
    "op9_chats": """
        WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
                AS position,
                count(*) OVER (PARTITION BY conv_id) AS turns,
                md5(CASE WHEN role IS NULL THEN '-' ELSE '+' || role END) || md5(CASE WHEN text IS NULL THEN '-' ELSE '+' || text END)
                    AS mark
            FROM once
        ),
        prefixes AS (
            SELECT conv_id, position, turns,
                string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY position) AS prefix
            FROM placed
        ),
        whole AS (
            SELECT prefix, min(conv_id) AS conv_id, max(turns) AS n_turns, count(*) AS n_copies
            FROM prefixes WHERE position = turns GROUP BY prefix
        ),
        kept AS (
            SELECT * FROM whole
            WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.position < p.turns AND p.prefix = whole.prefix)
        )
        SELECT k.conv_id, k.n_turns, k.n_copies,
            string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), ''
                ORDER BY p.position) AS chat
        FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
        GROUP BY k.conv_id, k.n_turns, k.n_copies
    """,
    "op10_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ),
        groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY body)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM normal n JOIN groups g ON n.body = g.body
    """,
}
