"""Check SQL of the corpus queries, run by another engine on the same tables."""

from __future__ import annotations

from .filter_audit import FILTERS, ORDERS
from .license_scan import TEMPLATES
from .quality_rules import RULES, STOP_WORDS
from .shard_tree import tree

WS = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql(slack: int = 3, min_share: float = 0.6) -> str:
    grams = ", ".join(f"({t}, {q}, {x.k}, {_text(g)})" for t, x in enumerate(TEMPLATES) for q, g in enumerate(x.grams))
    facts = ", ".join(f"({t}, {_text(x.label)}, {x.phrase}, {len(x.grams)}, {len(x.words)}, {x.k})"
                      for t, x in enumerate(TEMPLATES))
    return rf"""WITH gram(template, q, k, gram) AS (VALUES {grams}),
    fact(template, label, phrase, n_grams, n_words, k) AS (VALUES {facts}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p2 AS (SELECT rid, w, unnest(range(len(w) - 1)) AS p FROM d),
    rolled AS (SELECT rid, p, 2 AS k, w[p + 1] || ' ' || w[p + 2] AS gram FROM p2
      UNION ALL SELECT rid, p, 3, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] FROM p2 WHERE p + 3 <= len(w)),
    vote AS (SELECT rid, template, p - q AS diagonal, bit_or(1::BIGINT << q) AS mask, min(p) AS f, max(p) AS l
      FROM rolled JOIN gram USING (k, gram) GROUP BY ALL),
    opened AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER o > {slack}, true) THEN 1 ELSE 0 END
      AS opens FROM vote JOIN fact USING (template) WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
    banded AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY diagonal) AS band FROM opened),
    band AS (SELECT rid, template, label, phrase, n_grams, n_words, bit_count(bit_or(mask)) AS votes, min(f) AS f,
      max(l) AS l, min(k) AS k FROM banded GROUP BY rid, template, band, label, phrase, n_grams, n_words),
    span AS (SELECT *, votes / n_grams AS share FROM band WHERE CASE WHEN phrase THEN votes = n_grams
      ELSE votes / n_grams >= {min_share} AND l - f + k <= n_words * 2 + {slack} END),
    one AS (SELECT rid, count(*) FILTER (phrase) AS n_base, min(f) FILTER (phrase) AS first_word,
      max(f) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM span GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
      last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN one USING (rid)"""


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{_B32}',
      (((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)),
      'string_agg', '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""


def quality_sql(min_words: int = 50, pct: int = 50) -> str:
    def holds(r) -> str:
        ratio = f"({r.over} / greatest({r.under}, 1))"
        return " AND ".join([f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None))

    failed = ", ".join(f"CASE WHEN NOT ({holds(r)}) THEN '{r.name}' END" for r in RULES)
    stop = ", ".join(_text(w) for w in STOP_WORDS)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WS}') AS ws, list_filter(string_split(t, chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT rid, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
    c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i + 1], ws[i + 2], ws[i + 3]) AS n FROM g),
    r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c
      WHERE n > 1) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT
      AS n_stop_words, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
    v AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {pct} * n_words AS base_failed,
      array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
      NOT base_failed AND failed_rules = '' AS kept FROM v"""


MIXING = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WS}'))::BIGINT AS size,
      ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END
      AS weight FROM s),
    l AS (SELECT *, (150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
      / (100 * (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)))::DOUBLE AS level FROM w
      WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
    f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS passes FROM t),
    b AS (SELECT *, target - passes * source_size AS rest FROM f),
    c AS (SELECT source, h, sum(size)::BIGINT AS z FROM d GROUP BY source, h),
    x AS (SELECT c.source, h, z, sum(z) OVER (PARTITION BY c.source ORDER BY h) AS after, rest
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source),
    k AS (SELECT source, min(h) AS h FROM x WHERE after > rest GROUP BY source),
    cut AS (SELECT k.source, CASE WHEN after - rest < rest - (after - z) THEN k.h + 1 ELSE k.h END AS cut FROM k
      JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.h = x.h)
    SELECT doc_id, size, source_size, target, size * (passes + CASE WHEN h < coalesce(cut, 0) THEN 1 ELSE 0 END) AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source"""


CHAT = r"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    a AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
    b AS (SELECT *, sum(23 + length(r) + length(x) + length(regexp_replace(r || x, '[^<\[\\]', '', 'g')))
      OVER (PARTITION BY conv_id ORDER BY i) AS chars FROM a)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
      coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
      sum(chars) FILTER (r = 'assistant' OR i = n)::BIGINT AS formatted_chars FROM b GROUP BY conv_id"""


def shard_sql(shards: int = 16, base: int = 16) -> str:
    def nodes(n: int) -> tuple[str, str, str]:
        t = tree(n, base)
        regions = [(r, "", str(r), sum(map(len, x))) for r, x in enumerate(t)]
        racks = [(k, str(r), f"{r}.{k}", len(y)) for r, x in enumerate(t) for k, y in enumerate(x)]
        leaves = [(s, f"{r}.{k}", f"{r}.{k}.{s}", 1) for r, x in enumerate(t) for k, y in enumerate(x) for s in y]
        return tuple(", ".join(f"({i}, '{p}', '{m}', {w})" for i, p, m, w in rows) for rows in (regions, racks, leaves))

    def level(n: int, name: str, at: int, above: str | None) -> str:
        u = (f"(('0x' || substr(md5(concat_ws('|', coalesce(d.doc_id::VARCHAR, ''), '{name}', v.m)), 1, 8))::BIGINT + 0.5::DOUBLE)"
             " / 4294967296::DOUBLE")
        join = f"JOIN {above} a USING (key) JOIN v ON v.p = a.m" if above else "CROSS JOIN v"
        return (f"{name}{n} AS (WITH v(i, p, m, w) AS (VALUES {nodes(n)[at]}) SELECT key, arg_min(v.m, -ln({u}) / v.w) AS m,"
                f" arg_min(v.i, -ln({u}) / v.w) AS i FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key, doc_id FROM documents) d"
                f" {join} GROUP BY key)")

    levels = [level(n, name, at, above and f"{above}{n}") for n in (shards, shards + 1)
              for at, (name, above) in enumerate((("region", None), ("rack", "region"), ("shard", "rack")))]
    return f"""WITH {', '.join(levels)},
    poly AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, j:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS raw FROM documents),
    e AS (SELECT *, hex(raw) AS x FROM d),
    f AS (SELECT doc_id, key, octet_length(raw)::BIGINT + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b:
      xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM e CROSS JOIN poly),
    b AS (SELECT *, ('0x' || substr(md5('slot|' || key || '|' || text_crc32), 1, 3))::BIGINT AS bucket FROM f)
    SELECT doc_id, size, text_crc32, 'key' AS law, s.i AS shard, row_number() OVER (PARTITION BY s.i
      ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, g.i AS grown_shard
    FROM b JOIN shard{shards} s USING (key) JOIN shard{shards + 1} g USING (key)"""


def audit_sql() -> str:
    steps = ", ".join(f"('{o}', {i + 1}, {1 << FILTERS.index(f)}, {sum(1 << FILTERS.index(x) for x in o[:i])})"
                      for o in ORDERS for i, f in enumerate(o))
    here = "bits & own <> 0 AND bits & before = 0"
    return rf"""WITH step(filter_order, step, own, before) AS (VALUES {steps}),
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''), '{WS}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS bits FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits)
    SELECT part, filter_order, step, coalesce(sum(n) FILTER (bits & (before | own) = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER ({here}), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before <> 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER ({here}), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER ({here}), 0)::BIGINT AS toxic_lost,
      coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (bits & own <> 0), 0)::BIGINT AS shapley
    FROM c CROSS JOIN step GROUP BY part, filter_order, step"""


PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, w, unnest(range(len(w))) AS i FROM p),
    f AS (SELECT lang, 1 AS size, w[i + 1] AS phrase, count(*) AS n FROM g GROUP BY ALL
      UNION ALL SELECT lang, 2, w[i + 1] || ' ' || w[i + 2], count(*) FROM g WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10
      UNION ALL SELECT lang, 3, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3], count(*) FROM g WHERE i + 3 <= len(w)
        GROUP BY ALL HAVING count(*) >= 10),
    c AS (SELECT lang, size, phrase, n AS a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS s FROM f WHERE size > 1),
    x AS (SELECT c.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM c
      JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(s[1:k], ' ')
      JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(s[k + 1:], ' ')),
    b AS (SELECT lang, phrase, size, a, s, arg_min({'l': l, 'r': r, 'score': score}, score * 10 + k) AS best FROM x GROUP BY ALL),
    i AS (SELECT lang, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase, a FROM b WHERE size = 3),
    m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
    k AS (SELECT b.lang, b.phrase, a, best FROM b LEFT JOIN m ON size = 2 AND m.lang = b.lang AND m.phrase = b.phrase
      WHERE longer IS NULL OR 100 * longer < 50 * a),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank FROM k),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
    SELECT lang, rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM o JOIN t USING (lang) WHERE rank <= 2000"""
