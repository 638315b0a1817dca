"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe, impact_index, jaccard, langid, manifest, merkle, nn_descent, packing, quality, repair, secrets, token_files, warc,
)
from shelfwise.llm.common import held_out, table
from shelfwise.llm.pieces import tokenizer_path
from shelfwise.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from shelfwise.session import shared_dir

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to token files and read back: where they start, how many, their checksum."""
    folder = shared_dir(spark, "token-data")
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, tokenizer_path(WORD_BPE), kind="word", end_id=1
    )
    return token_files.read_token_files(spark, folder, files)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 ids."""
    return packing.pack_examples(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), kind="byte", end_id=0)


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the segment tree and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


@query(
    "op3_warc",
    sql="""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> kept THEN kept END AS refers_to
    FROM k
    """,
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by verified record boundaries."""
    folder = shared_dir(spark, "warc-data")
    files = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, files, folder)


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = langid.predict_language(docs.select("doc_id", "text"), langid.learn(docs), keep_text=False)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_symbols")


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@query("op10_merkle")
def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of it with its last third replaced from the next one."""
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


@query(
    "op6_jaccard",
    sql=r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (
      SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM w),
    shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sets),
    sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
    common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
    SELECT s.doc_id, n AS n_shingles, min(seen) AS component_id FROM sizes s JOIN reach USING (doc_id) GROUP BY 1, 2
    """,
)
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles have a Jaccard similarity of at least 0.85."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query(
    "op2_nn_descent",
    sql="""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    usable AS (
      SELECT * FROM v
      WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
        AND list_sum(list_transform(x, lambda e: e * e)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
    reach AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.seen),
    least AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY 1),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)
    """,
)
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of the same label with a cosine of at least 0.93, and their groups."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op11_impact_index",
    sql="""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, list_transform(x, lambda e: CAST(floor(1024 * e) AS BIGINT)) AS w FROM v
          WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
          FROM u q JOIN u c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    QUALIFY rank <= 10
    """,
)
def op11_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the highest integer inner product for every hundredth id."""
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# crc32 of a text of ASCII characters.
CRC32 = """list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(8)),
             lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))),
                               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


@query(
    "op12_repair",
    sql=rf"""
    WITH RECURSIVE crcs AS (SELECT {CRC32} AS crc),
    given AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    kinds AS MATERIALIZED (SELECT *, {crc32_sql("k")} % 20 AS kind FROM given, crcs),
    damaged AS (
      SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again
      FROM kinds WHERE kind <> 0),
    placed AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
    faults AS (
      SELECT *, regexp_matches(text, '[^ 	-
]') AS said, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again_said,
             NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, substr(role, 1, 1) AS initial,
             substr(lag(role) OVER (PARTITION BY conv ORDER BY pos), 1, 1) || substr(role, 1, 1) AS two FROM placed),
    judged AS MATERIALIZED (
      SELECT *, NOT said AS blank, said AND again_said AS duplicate, said AND NOT again_said AND cut AS truncated,
             NOT said OR again_said AS must_go FROM faults),
    counts AS (
      SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
             count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM judged GROUP BY conv),
    edits(kind, initial, p, q, cost) AS (VALUES ('K', 's', '0', 's', 0), ('K', 'u', '0', 'u', 0), ('K', 'u', 's', 'u', 0), ('K', 'u', 'a', 'u', 0), ('K', 'a', 'u', 'a', 0),
      ('R', '', '0', 'u', 1), ('R', '', 's', 'u', 1), ('R', '', 'a', 'u', 1), ('R', '', 'u', 'a', 1),
      ('D', '', '0', '0', 2), ('D', '', 's', 's', 2), ('D', '', 'u', 'u', 2), ('D', '', 'a', 'a', 2)),
    inserts(p, q, cost, txt) AS (VALUES ('0', '0', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''),
      ('0', 'u', 5, 'I'), ('s', 'u', 5, 'I'), ('a', 'u', 5, 'I'), ('u', 'a', 5, 'I'), ('0', 'a', 10, 'II'), ('s', 'a', 10, 'II')),
    dp AS (
      SELECT conv, CAST(0 AS BIGINT) AS pos, q AS state, printf('%08d', cost) || txt AS best FROM counts, inserts WHERE p = '0'
      UNION ALL
      SELECT d.conv, r.pos, i.q,
             min(printf('%08d', CAST(substr(d.best, 1, 8) AS BIGINT) + e.cost + i.cost + CASE WHEN e.kind <> 'D' AND r.truncated THEN 5 ELSE 0 END)
                 || substr(d.best, 9) || e.kind || i.txt)
      FROM dp d JOIN judged r ON r.conv = d.conv AND r.pos = d.pos + 1
      JOIN edits e ON e.p = d.state AND (e.kind <> 'K' OR e.initial = r.initial) AND (e.kind = 'D' OR NOT r.must_go)
      JOIN inserts i ON i.p = e.q GROUP BY d.conv, r.pos, i.q),
    found AS (SELECT conv, min(best) AS best FROM dp JOIN counts USING (conv) WHERE pos = last AND state IN ('0', 'a') GROUP BY conv),
    chars AS (SELECT conv, substr(best, 9) AS audit, unnest(range(1, length(best) - 7)) AS place FROM found),
    steps AS (
      SELECT conv, place, audit[place] AS ch, count(*) FILTER (audit[place] <> 'I') OVER w AS pos, count(*) FILTER (audit[place] <> 'D') OVER w AS out
      FROM chars WINDOW w AS (PARTITION BY conv ORDER BY place)),
    kept AS (
      SELECT s.conv, s.ch, s.out, r.role, CASE WHEN s.ch = 'I' THEN '' ELSE r.text END AS text,
             max(CASE WHEN s.out = 1 AND s.ch = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv) AS shift
      FROM steps s LEFT JOIN judged r ON r.conv = s.conv AND r.pos = s.pos WHERE s.ch <> 'D'),
    texts AS (
      SELECT conv, string_agg(CASE WHEN ch = 'K' THEN role WHEN (out - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY out) AS repaired
      FROM kept GROUP BY conv)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 8) AS BIGINT), 0) AS cost, coalesce(substr(best, 9), '') AS audit,
           sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, conv FROM given) LEFT JOIN counts USING (conv) LEFT JOIN found USING (conv) LEFT JOIN texts USING (conv)
    """,
)
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired by interval parsing."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def part_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(part_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


@query(
    "op13_manifest",
    sql=f"""
    WITH RECURSIVE crcs AS (SELECT {CRC32} AS crc),
    rows AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf_sql("n_chars")} AS leaf, {leaf_sql("(n_chars + 1)")} AS other,
                    CAST(doc_id AS VARCHAR) AS k FROM documents),
    leaves AS MATERIALIZED (
      SELECT doc_id, tree, leaf, CASE WHEN {crc32_sql("k")} % 7 = 0 THEN other ELSE leaf END AS tampered,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM rows, crcs),
    nodes AS (
      SELECT tree, 0 AS level, place, n, leaf AS h FROM leaves
      UNION ALL
      SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
    subroots AS MATERIALIZED (
      SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
    crown AS (
      SELECT 0 AS level, place, n, subroot AS h FROM subroots
      UNION ALL
      SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY level, place // 2, n),
    levels AS (SELECT DISTINCT tree, level FROM nodes WHERE n > 1),
    steps AS (
      SELECT l.tree, l.place, v.level, CASE WHEN s.h IS NULL THEN '.' WHEN (l.place >> v.level) & 1 = 1 THEN '<' || s.h ELSE '>' || s.h END AS step
      FROM leaves l JOIN levels v USING (tree) LEFT JOIN nodes s ON s.tree = l.tree AND s.level = v.level AND s.place = xor(l.place >> v.level, 1)
      UNION ALL
      SELECT l.tree, l.place, 1000 + v.level, CASE WHEN s.h IS NULL THEN '.' WHEN (r.place >> v.level) & 1 = 1 THEN '<' || s.h ELSE '>' || s.h END
      FROM leaves l JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM crown WHERE n > 1) v ON true
      LEFT JOIN crown s ON s.level = v.level AND s.place = xor(r.place >> v.level, 1)),
    paths AS (SELECT tree, place, list(step ORDER BY level) AS path FROM steps GROUP BY 1, 2),
    found AS (
      SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM crown WHERE n = 1) AS root,
             sha256(coalesce(array_to_string(list_transform(path, lambda s: substr(s, 2)), ''), '')) AS proof_sha256,
             list_reduce(list_concat([l.tampered], coalesce(path, [])), lambda h, s: CASE s[1] WHEN '.' THEN sha256(h) WHEN '<' THEN sha256(substr(s, 2) || h) ELSE sha256(h || substr(s, 2)) END) AS folded_root
      FROM leaves l JOIN subroots r USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.place = l.place)
    SELECT *, folded_root = root AS verified FROM found
    """,
)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proofs and verification of every document, some of them tampered with."""
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.every_seventh(F.col("doc_id")))
