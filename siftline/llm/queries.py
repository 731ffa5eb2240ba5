"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import ann, bitslice, bpe, chat, ctw, jaccard, langid, merkle, packing, quality, secrets, sharding, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op3_chat(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 4, 2)
    profiles = langid.learn(docs.where(~out))
    found = langid.predict(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host="source", path="lang")


def op7_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secrets.named(base), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


def op8_ctw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = ctw.score(docs, ~langid.held_out("doc_id", 7, 2))
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_topk(spark, sf_dir):
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_trie(spark, sf_dir):
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_sharding(spark, sf_dir):
    placed = sharding.shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


QUERIES = {f.__name__: f for f in (op1_ann, op2_packing, op3_chat, op4_langid, op5_jaccard, op6_quality, op7_secrets, op8_ctw, op9_bpe, op10_topk, op11_trie, op12_sharding, op13_merkle)}
#: crc32 of the text of doc_id
CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
#: crc32 of the bytes of text, by the table k of (t) that stands for each byte
CRC_TABLE = "SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)"
CRC_TEXT = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
         lambda c, b: xor(c >> 8, k.t[(xor(c, b) & 255) + 1])))"""


def _levels(first: str, group: str, n: int) -> str:
    """Tables {first}1 to {first}n: the runs of 16 above {first}0 (group, place i, digest h); a lone node is passed on."""
    made = []
    for level in range(n):
        below = f"{first}{level}"
        made.append(f"""{below}c AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS c FROM {below}),
        {first}{level + 1} AS (SELECT {group}, i // 16 AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {below}c GROUP BY {group}, i // 16)""")
    return ", ".join(made)


def _sides(first: str, level: int, group: str, at: str, key: str) -> str:
    """Of each row of {at} ({key}, group, place i): what stands before and after it in its run of the level."""
    own = f"{at}.i // {16**level}"
    side = lambda op: f"coalesce(string_agg(CASE WHEN n.i {op} {own} THEN n.h END, '' ORDER BY n.i), '')"
    return f"(SELECT {at}.{key}, {side('<')} AS b, {side('>')} AS a, count(*) AS m FROM {at} JOIN {first}{level} n ON n.{group} IS NOT DISTINCT FROM {at}.{group} AND n.i // 16 = {at}.i // {16 ** (level + 1)} GROUP BY {at}.{key}, {own})"


def _merkle_sql(own: int = 5, over: int = 3) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in [*merkle.FIELDS[:-1], text]) + ")"
    steps = [("d", k, "source", "l", "r") for k in range(own)] + [("s", k, "g", "q", "r") for k in range(over)]
    chain, before = [], "SELECT r, h, u AS f, '' AS p FROM l"
    for step, (first, level, group, at, key) in enumerate(steps):
        folded = "CASE WHEN z.m = 1 THEN x.f ELSE sha256(z.b || x.f || z.a) END"
        chain.append(f"w{step} AS (SELECT x.r, x.h, {folded} AS f, x.p || z.b || z.a AS p FROM ({before}) x JOIN {_sides(first, level, group, at, key)} z ON z.r = x.r)")
        before = f"SELECT * FROM w{step}"
    return f"""
        WITH i AS (SELECT doc_id, source, row_number() OVER () AS r, {leaf("text")} AS h, CASE WHEN {CRC} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS u FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i FROM i),
        d0 AS (SELECT source, i, h FROM l), {_levels("d", "source", own)},
        s0 AS (SELECT 0 AS g, source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, h FROM d{own}), {_levels("s", "g", over)},
        q AS (SELECT l.r, 0 AS g, s0.i FROM l JOIN s0 ON s0.source IS NOT DISTINCT FROM l.source),
        {", ".join(chain)}
        SELECT l.doc_id, l.h AS leaf, s0.h AS subroot, t.h AS root, sha256(w.p) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
        FROM ({before}) w JOIN l ON l.r = w.r JOIN s0 ON s0.source IS NOT DISTINCT FROM l.source CROSS JOIN s{over} t"""


SQL: dict[str, str] = {
    "op4_langid": f"""
        WITH d AS (SELECT doc_id, lang, {CRC} % 4 = 2 AS held_out, ' ' || trim(lower(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'))) || ' ' AS t FROM documents),
        c AS (SELECT doc_id, lang, held_out, list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM d WHERE length(t) > 2),
        g AS (SELECT doc_id, lang, held_out, u[i] AS a, u[i + 1] AS b, u[i + 2] AS c FROM c, unnest(range(1, CAST(len(u) + 1 AS BIGINT))) AS t(i)),
        n AS (SELECT doc_id, lang, held_out, a AS gram FROM g WHERE a <> 32 UNION ALL SELECT doc_id, lang, held_out, (a << 21) | b FROM g WHERE b IS NOT NULL AND (a <> 32 OR b <> 32)
              UNION ALL SELECT doc_id, lang, held_out, (a << 42) | (b << 21) | c FROM g WHERE c IS NOT NULL AND b <> 32),
        k AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM n GROUP BY ALL),
        p AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS r FROM k WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) WHERE r < 300),
        o AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS r FROM k) WHERE r < 300),
        l AS (SELECT DISTINCT lang FROM p), s AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1),
        a AS (SELECT o.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(p.r - o.r) END) AS away FROM o CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = o.gram GROUP BY 1, 2),
        b AS (SELECT doc_id, lang, away, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS q FROM a)
        SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, CASE WHEN b.lang IS NULL THEN 0 ELSE 1 - b.away / (300.0 * s.n) END AS score
        FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.q = 1 LEFT JOIN s ON s.doc_id = d.doc_id""",
    "op5_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS (SELECT doc_id, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 90 * (len(x.s) + len(y.s) - i)),
        k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS node, a AS root FROM k UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.node)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = s.doc_id""",
    "op3_chat": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx,
                     count(*) OVER (PARTITION BY conv_id) AS n FROM t),
        p AS (SELECT *, string_agg(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-') || chr(2), '') OVER
                     (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM i),
        w AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE idx = n GROUP BY n, prefix),
        k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.idx < p.n AND p.idx = w.n AND p.prefix = w.prefix))
        SELECT k.conv_id, k.n AS n_turns, k.n_logged,
               string_agg('<|im_start|>' || coalesce(i.role, '') || chr(10) || coalesce(i.text, '') || '<|im_end|>' || chr(10), '' ORDER BY i.idx) AS chat
        FROM k JOIN i ON i.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.n_logged""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * r.x[i])) AS BIGINT) AS score
              FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.x) = len(r.x) WHERE q.vec_id % 50 = 0),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5""",
    "op11_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
        v AS (SELECT DISTINCT c, c - c % 100 AS b, {CRC.replace("doc_id", "c")} % 6 AS h FROM t),
        r AS (SELECT v.c, 0 AS own, t.i, t.role, t.x FROM v JOIN t ON t.c = v.b AND t.i <= v.h UNION ALL SELECT v.c, 1, t.i, t.role, t.x FROM v JOIN t ON t.c = v.c AND t.i > v.h),
        s AS (SELECT c, role, x, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM r),
        k AS (SELECT c, d, length(x) AS l, sha256(string_agg(strlen(role) || ':' || role || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p FROM s
              UNION ALL SELECT c, 0, 0, '' FROM v),
        n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, max(l) AS l FROM k GROUP BY d, p),
        m AS (SELECT c, max(d) AS d FROM k GROUP BY c),
        e AS (SELECT k.d, k.p, string_agg(CAST(k.c AS VARCHAR), ',' ORDER BY k.c) AS ids FROM k JOIN m ON m.c = k.c AND m.d = k.d GROUP BY k.d, k.p),
        o AS (SELECT k.d, k.p, count(*) AS n_children FROM n JOIN k ON k.c = n.conv_id AND k.d = n.d - 1 GROUP BY k.d, k.p),
        a AS (SELECT k.d, k.p, count(*) FILTER (WHERE o.p IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.l) AS saved FROM n JOIN k ON k.c = n.conv_id AND k.d <= n.d LEFT JOIN o ON o.d = n.d AND o.p = n.p GROUP BY k.d, k.p)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(o.n_children, 0) AS n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM n JOIN a ON a.d = n.d AND a.p = n.p LEFT JOIN o ON o.d = n.d AND o.p = n.p LEFT JOIN e ON e.d = n.d AND e.p = n.p
        LEFT JOIN k ON k.c = n.conv_id AND k.d = n.d - 1 LEFT JOIN n u ON u.d = k.d AND u.p = k.p""",
    "op12_sharding": f"""
        WITH k AS ({CRC_TABLE}), d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {CRC_TEXT} AS text_crc32 FROM documents CROSS JOIN k),
        p AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS i, sum(size) OVER () AS total FROM d),
        b AS (SELECT *, sum(size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM p),
        s AS (SELECT *, CAST(least((2 * before + size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM b)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op13_merkle": _merkle_sql(),
}
