"""The registered queries of the training-data operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm import best_fit, conversation_repair, embedding_join, exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, mixing, token_counts, token_files, toxicity, whitening
from bramble.llm.common import new_path, read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), new_path(spark, "token-files")
    token_files.write_token_files(docs, folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_digests(spark, folder, docs)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_groups(read(spark, sf_dir, "documents"), k=3, numerator=90, denominator=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_best_fit_packing, op3_source_mixing, op4_toxicity, op5_html_extraction, op6_token_files, op7_embedding_near_dedup, op8_token_counts, op9_jaccard_join, op10_exact_dedup, op11_embedding_whitening, op12_lm_scoring, op13_conversation_repair)
}



def _least(*paths: str) -> str:
    return f"list_min(list_filter([{', '.join(paths)}], lambda x: x IS NOT NULL))"


def _edit(state: str, cost: str, edit: str, row: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {edit}, 't': {state}.t || {row}}} END"


_INSERTED = ("'I'", "chr(10) || 'user:'", "chr(10) || 'assistant:'")
_KEPT = "chr(10) || role || ':' || text"
_OPEN = ("CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END", f"CASE WHEN initial = 'u' THEN {_KEPT} ELSE chr(10) || 'user:' || text END")
_CLOSE = ("CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END", f"CASE WHEN initial = 'a' THEN {_KEPT} ELSE chr(10) || 'assistant:' || text END")


def _taken(state: str, allowed: str, cost: str, edit: tuple[str, str]) -> str:
    return f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND {allowed} THEN {_edit(state, f'({cost}) + CASE WHEN fault = ' + chr(39) + 'truncated' + chr(39) + ' THEN 5 ELSE 0 END', *edit)} END"


def _repair_sql() -> str:
    """Row by row from the left: the cheapest edits that lead to each state, with the text they give."""
    opened, closed = "CASE WHEN initial = 'u' THEN 0 ELSE 1 END", "CASE WHEN initial = 'a' THEN 0 ELSE 1 END"
    gone = [_edit(f"s{i}", "2", "'D'") for i in range(4)]
    n1 = _least(_taken("s0", "initial = 's'", "0", ("'K'", _KEPT)), gone[1])
    n2 = _least(*[_taken(s, "TRUE", opened, _OPEN) for s in ("s0", "s1", "s3")], gone[2])
    n3 = _least(_taken("s2", "TRUE", closed, _CLOSE), gone[3])
    more2 = _least("n2", *[_edit(s, "5", *_INSERTED[:2]) for s in ("n0", "n1", "n3")])
    more3 = _least("n3", _edit("m2", "5", _INSERTED[0], _INSERTED[2]))
    grow = lambda source: f"SELECT conv_id, pos, n0 AS s0, n1 AS s1, m2 AS s2, {more3} AS s3 FROM (SELECT *, {more2} AS m2 FROM ({source}) AS n) AS m"
    empty = "{'c': 0, 'a': '', 't': ''}"
    none = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR))"
    return rf"""
        WITH RECURSIVE hit AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1))))) % 20 AS kind
            FROM conversations),
        dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM hit JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR kind = 3 WHERE kind <> 0),
        num AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM dmg),
        rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
            coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS odd FROM num),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        best AS (
            {grow(f"SELECT conv_id, 0::BIGINT AS pos, {empty} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM ids")}
            UNION ALL
            {grow(f"SELECT conv_id, pos, {gone[0]} AS n0, {n1} AS n1, {n2} AS n2, {n3} AS n3 FROM (SELECT r.conv_id, r.pos, initial, role, text, fault, s0, s1, s2, s3 FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1) AS j")}),
        found AS (SELECT conv_id, {_least('s0', 's3')} AS f FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM rows GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            f.c::BIGINT AS cost, f.a AS audit, sha256(substr(f.t, 2)) AS repaired_sha256
        FROM ids i JOIN found g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN facts k ON k.conv_id IS NOT DISTINCT FROM i.conv_id
    """


ORACLES: dict[str, str] = {
    "op13_conversation_repair": _repair_sql(),
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n
    """,
    "op7_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
               AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
                  AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
    """,
}
