"""Registered queries of this package, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowlark.llm import bloom_dedup, bpe, conversation_repair, entropy_mix, language_svm, line_templates, order_minhash, projected_search, source_divergence, speculative_bpe, training_order, url_rules, warc
from windowlark.llm.support import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return keep


@query("op1_warc")
def _(spark, folder):
    manifest = warc.archive_pages(table(spark, folder, "pages"))
    return warc.read_archives(manifest, payload=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_order_minhash")
def _(spark, folder):
    return order_minhash.near_duplicates(table(spark, folder, "documents")).drop("rk")


@query("op3_language_svm")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_svm.fit_languages(docs.where(third != 1))
    held = F.coalesce(third == 1, F.lit(False))
    return language_svm.predict_languages(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op4_bpe")
def _(spark, folder):
    ranks = bpe.read_ranks(VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = bpe.bpe_encode(docs, "text", ranks, public_tokenizers.PATTERN, carry=["doc_id"])
    decoded = bpe.bpe_decode(ids, "ids", ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


@query(
    "op5_bloom_dedup",
    f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({_SQUEEZED}) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER best = 1 AS kept, text_sha256
        FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)""",
)
def _(spark, folder):
    return bloom_dedup.bloom_dedup(table(spark, folder, "documents"))


#: The rules of the registered query: host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op6_url_rules",
    r"""WITH u AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r AS (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
)
def _(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


_FOLDED = r"regexp_replace(line, '[\x09-\x0D]', ' ', 'g')"

#: Oracle of the template tree, with token strings for hashes; also used by the pipeline.
TEMPLATE_SQL = rf"""
lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM docs),
filled AS (SELECT *, regexp_split_to_array(trim({_FOLDED}), ' +') AS tokens FROM lines WHERE trim({_FOLDED}) <> ''),
seen AS (SELECT *, (len(tokens), list_transform(tokens[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END)) AS leaf FROM filled),
wordings AS (SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT (doc_id, text)) AS docs, CASE WHEN leaf[1] > 50 THEN 2 ELSE 10 END AS need
             FROM seen GROUP BY leaf, line),
placed AS (SELECT * FROM (SELECT leaf, line, docs, need, len(list_filter(tokens, lambda t: NOT regexp_matches(t, '[0-9]'))) AS size,
           unnest(tokens) AS token, generate_subscripts(tokens, 1)::BIGINT AS place FROM wordings
           WHERE leaf IN (SELECT leaf FROM wordings GROUP BY leaf, need HAVING sum(docs) >= need)) WHERE NOT regexp_matches(token, '[0-9]')),
constants AS (SELECT leaf, place, token, sum(docs) AS n FROM placed GROUP BY leaf, place, token, need HAVING sum(docs) >= need),
held AS (SELECT *, row_number() OVER (PARTITION BY leaf, line ORDER BY n DESC) AS nth FROM placed JOIN constants USING (leaf, place, token)),
levelled AS (SELECT *, max(CASE WHEN nth = greatest(ceil(size * 0.8::DOUBLE), 1) THEN n END) OVER (PARTITION BY leaf, line) AS level FROM held),
named AS (SELECT leaf, line, list((place, token) ORDER BY place) AS template, CASE WHEN count(*) < 40 THEN 10 ELSE need END AS asks
          FROM levelled WHERE n * 2 >= level GROUP BY leaf, line, need),
templates AS (SELECT leaf, line, template, asks FROM named
              UNION ALL SELECT leaf, line, [(0::BIGINT, line)], need FROM wordings LEFT JOIN named USING (leaf, line)
              WHERE docs >= need AND (asks IS NULL OR asks > need)),
hits AS (SELECT leaf, template, asks, doc_id, text, line_no FROM seen JOIN templates USING (leaf, line)),
recurring AS (SELECT leaf, template, min((doc_id, line_no)) AS first FROM hits GROUP BY leaf, template, asks HAVING count(DISTINCT (doc_id, text)) >= asks),
gone AS (SELECT doc_id, text, list(line_no) AS lines FROM (SELECT DISTINCT doc_id, text, line_no FROM hits JOIN recurring USING (leaf, template)
         WHERE (doc_id, line_no) <> first) GROUP BY doc_id, text),
cleaned AS (SELECT d.doc_id, CASE WHEN g.lines IS NULL THEN d.text ELSE
              array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.lines, i)), chr(10)) END AS text,
              d.lang, d.source, d.n_chars, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(len(g.lines), 0) AS n_dropped
            FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text)"""


@query("op7_line_templates", f"WITH docs AS (SELECT * FROM documents), {TEMPLATE_SQL} SELECT doc_id, text, n_lines, n_dropped FROM cleaned")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, counts=True)


@query("op8_projected_search")
def _(spark, folder):
    return projected_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_entropy_mix")
def _(spark, folder):
    return entropy_mix.mix_sources(table(spark, folder, "documents"))


@query("op10_training_order")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    manifest, facts = training_order.materialise_order(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN, copies=True)
    read = training_order.read_slots(manifest, facts, with_ids=False)
    return read.select("slot", "sequence", "shard", "offset", F.col("sha256").alias("ids_sha256"))


@query("op13_speculative_bpe")
def _(spark, folder):
    tokenizer = speculative_bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = speculative_bpe.encode(docs, "text", tokenizer, carry=["doc_id"], packed=True)
    decoded = speculative_bpe.decode(ids, "ids", tokenizer)
    return decoded.select(
        "doc_id",
        speculative_bpe.count_ids("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Oracle of the repair: the same automaton, with whole audit strings and bodies as carried values.
_REPAIR_SQL = r"""WITH RECURSIVE
crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295],
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
moves AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 1, 2, 'user:'), (0, 2, 3, 'user:' || chr(10) || 'assistant:'), (1, 0, 1, ''), (1, 1, 2, 'user:'),
            (1, 2, 3, 'user:' || chr(10) || 'assistant:'), (2, 0, 2, ''), (2, 1, 3, 'assistant:'), (2, 2, 2, 'assistant:' || chr(10) || 'user:'),
            (3, 0, 3, ''), (3, 1, 2, 'user:'), (3, 2, 3, 'user:' || chr(10) || 'assistant:')) m(q, k, mid, added)),
edits AS (SELECT * FROM (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3),
            (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
            (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)) e(mid, letter, initial, to_q)),
states AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'body': ''} AS best FROM faults
    UNION ALL
    SELECT s.conv_id, s.i + 1, e.to_q, min({
        'cost': s.best.cost + 2 * k + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
        'audit': s.best.audit || repeat('I', k) || letter,
        'body': array_to_string(list_filter([s.best.body, added, CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text
            ELSE CASE to_q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text END], lambda x: x <> ''), chr(10))})
    FROM states s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN moves m ON m.q = s.q JOIN edits e ON e.mid = m.mid
    WHERE (e.initial IS NULL OR e.initial = f.initial) AND (letter = 'D' OR fault IS NULL OR fault = 'truncated') GROUP BY s.conv_id, s.i, e.to_q),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
            count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
           FROM faults GROUP BY conv_id),
ends AS (SELECT s.conv_id, min({'cost': s.best.cost + 2 * k, 'audit': s.best.audit || repeat('I', k),
            'body': array_to_string(list_filter([s.best.body, added], lambda x: x <> ''), chr(10))}) AS best
         FROM states s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN moves m ON m.q = s.q WHERE m.mid IN (0, 3) GROUP BY s.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
    coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op12_conversation_repair", _REPAIR_SQL)
def _(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair_conversations(conversation_repair.damaged(rows))
    return conversation_repair.audit_all(rows, conversation_repair.audit_conversations(repaired))


@query(
    "op11_source_divergence",
    r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        occurrences AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        uses AS (SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN uses USING (lang, source) GROUP BY ALL),
        shares AS (SELECT lang, source, term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.total + v) AS p,
            1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + v) AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN uses u USING (lang, source, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
        QUALIFY part = 'pair' OR rank <= 200""",
)
def _(spark, folder):
    return source_divergence.source_divergence(table(spark, folder, "documents"))
