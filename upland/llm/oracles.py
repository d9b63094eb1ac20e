"""SQL of the training-data queries that SQL can express, for DuckDB, in the words of the contracts."""

from __future__ import annotations

from upland.llm import mixing, quality

#: White-space words, and the text of a document in lower case (A to Z alone).
WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """The CRC-32 of a short ASCII text, bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda a, i: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda c, b: {step}), 4294967295::UBIGINT)"


def licence_base() -> str:
    phrases = {"apache": ["apache", "license"], "gpl": ["general", "public", "license"], "mit": ["mit", "license"]}

    def places(label: str, words: list[str]) -> str:
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        return f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})"

    every = ", ".join(places(k, v) for k, v in phrases.items())
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, {words}) AS w FROM documents), p AS (SELECT doc_id, w, flatten([{every}]) AS f FROM t)
      SELECT doc_id, len(w) AS n_words, len(f) AS n_base, list_min(list_transform(f, lambda x: x.at)) AS first_word,
        list_max(list_transform(f, lambda x: x.at)) AS last_word,
        coalesce(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.label))), ','), '') AS base_labels FROM p"""


def quality_rules() -> str:
    space = r"'[^\x20\x09-\x0D]'"
    symbols = "'[#*$%&|<>]'"
    count = lambda pattern: f"len(regexp_extract_all(text, {pattern}))"
    digits, capitals = count("'[0-9]'"), count(r"'\p{Lu}'")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      w AS (SELECT *, regexp_extract_all(text, {WORDS}) AS words, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, {space})) AS lines FROM t),
      g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
      c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times > 1) GROUP BY doc_id),
      f AS (SELECT w.doc_id, text, words, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        {count(symbols)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, len(lines) AS n_lines
        FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
        NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * n_lines
        OR 10 * {digits} > 3 * word_chars OR 10 * {capitals} > 6 * word_chars OR len(list_intersect(words, [{stops}])) < 2) AS kept FROM b"""


def lm_base() -> str:
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w, {crc32_sql("doc_id::VARCHAR")} % 7 = 2 AS held_out FROM documents),
      tr AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM t WHERE NOT held_out),
      c AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM t WHERE NOT held_out) GROUP BY word), v AS (SELECT count(*) + 1 AS v FROM c),
      p AS (SELECT doc_id, unnest(w) AS word FROM t),
      s AS (SELECT doc_id, sum(log10(coalesce(c, 0) + 1)) AS s, count(c) AS known FROM p LEFT JOIN c ON p.word = c.word GROUP BY doc_id)
      SELECT t.doc_id, held_out, len(w) + 1 AS n_tokens, coalesce(known, 0) + 1 AS n_known, words + docs AS train_tokens,
        round(coalesce(s, 0) + log10(docs + 1) - (len(w) + 1) * log10(words + docs + v + 1), 5) AS base_score
      FROM t LEFT JOIN s ON t.doc_id = s.doc_id CROSS JOIN tr CROSS JOIN v"""


def jaccard(size: int = 3, num: int = 90, den: int = 100) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
      s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: {shingle}) END)) AS g FROM t),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      pairs AS (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE {den} * both_have >= {num} * (x.n + y.n - both_have)),
      ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
      least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
      SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(least.b, t.doc_id)) AS component_id
      FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN least ON t.doc_id = least.a"""


def mix_targets() -> str:
    """Sizes and targets: a source stops at its cap if the level that the others reach without it lies above its ratio."""
    weights = ", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS)
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size FROM documents),
      s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
      k AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
      o AS (SELECT *, {mixing.MOST} * source_size AS cap, sum(source_size) OVER () AS total FROM k),
      l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
      w AS (SELECT min_by(level, cap / weight) FILTER (WHERE cap >= level * weight) AS water FROM l),
      g AS (SELECT source, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM l CROSS JOIN w)
      SELECT d.doc_id, d.size, g.source_size, round(g.target, 4) AS target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source"""


def collocations() -> str:
    return rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
      o AS (SELECT lang, unnest(w) AS p FROM w
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
      f AS (SELECT lang, p, count(*)::HUGEINT AS f, string_split(p, ' ') AS w FROM o GROUP BY lang, p HAVING count(*) >= 10),
      n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
      k AS (SELECT lang, p, f AS a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
      c AS (SELECT k.lang, k.p, a, k, k.w, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score FROM k
        JOIN f x ON x.lang = k.lang AND x.p = array_to_string(k.w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.p = array_to_string(k.w[k + 1:], ' ')),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS best FROM c),
      d AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a AS longer FROM b WHERE best = 1 AND len(w) = 3),
      m AS (SELECT lang, p, max(longer) AS longer FROM d GROUP BY lang, p),
      q AS (SELECT b.* FROM b LEFT JOIN m ON b.lang = m.lang AND b.p = m.p WHERE best = 1 AND coalesce(100 * longer < 50 * a, true)),
      z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM q)
      SELECT z.lang, rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
      FROM z JOIN n ON z.lang = n.lang WHERE rank <= 2000"""


def source_divergence() -> str:
    return rf"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
      o AS (SELECT d, lang, source, unnest(w) AS term FROM t),
      k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT d) >= 3), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
      g AS (SELECT DISTINCT lang, source FROM t),
      c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
      f AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM g JOIN k ON g.lang = k.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
      n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM f GROUP BY ALL),
      p AS (SELECT f.lang, f.source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS p
        FROM f JOIN n ON f.lang = n.lang AND f.source = n.source JOIN v ON f.lang = v.lang),
      l AS (SELECT s.lang, term, 1 + (1000000000::HUGEINT * (s.c + 1)) // (m.n + v) AS p FROM (SELECT lang, term, sum(c) AS c FROM f GROUP BY ALL) s
        JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON s.lang = m.lang JOIN v ON s.lang = v.lang),
      pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
      terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - l.p) * (p.p - l.p)) // l.p AS value
        FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.c > 0 AND p.p > l.p),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
      SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


def exact_dedup() -> str:
    return """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size, sha256(text) AS text_sha256 FROM t GROUP BY text)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g ON t.text = g.text"""
