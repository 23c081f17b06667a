"""The graph model as DuckDB SQL, written apart from the DataFrame code that it checks."""

from __future__ import annotations

import re

TABLES = {
    "lines": """SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem""",
    "ordered": """SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "nodes": """
      SELECT 'r' || r_regionkey AS id, 'region' AS kind, r_name AS content, NULL::VARCHAR AS parent_id,
             r_regionkey::INTEGER AS position, 'r' || r_regionkey AS path, '{}' AS metadata FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 'r' || n_regionkey, n_nationkey,
             'r' || n_regionkey || '.n' || n_nationkey, '{}' FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, 'n' || c_nationkey, c_custkey::INTEGER,
             'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey, '{"segment":"' || c_mktsegment || '"}'
             FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'o' || o_orderkey, 'order', o_orderpriority, 'c' || o_custkey, o_orderkey::INTEGER,
             'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey || '.o' || o_orderkey,
             '{"status":"' || o_orderstatus || '"}' FROM ordered
      UNION ALL SELECT 'p' || p_partkey, 'part', p_name, NULL, p_partkey::INTEGER, 'parts.p' || p_partkey,
             '{"brand":"' || p_brand || '"}' FROM part
      UNION ALL SELECT 'l' || l_orderkey || '_' || ordinal, 'line', l_returnflag, 'o' || l_orderkey, ordinal::INTEGER,
             'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey || '.o' || o_orderkey
             || '.l' || l_orderkey || '_' || ordinal, '{"status":"' || l_linestatus || '"}'
             FROM lines JOIN ordered ON l_orderkey = o_orderkey""",
    "edges": """
      SELECT DISTINCT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, 'contains' AS relation FROM lineitem
      UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by' FROM lineitem""",
    "agents": """SELECT DISTINCT 'u' || user_id AS id, 'u' || user_id AS name,
      ['human', 'llm', 'tool', 'swarm'][user_id % 4 + 1] AS kind FROM events""",
    "perspective_log": """SELECT 'u' || user_id AS agent_id, 'p' || json_extract_string(props, '$.k') AS node_id,
      event_type AS context_id, greatest(-1.0, least(1.0, value / 250 - 1)) AS weight, ts AS updated_at, event_id AS seq
      FROM events""",
    "perspectives": """SELECT * EXCLUDE (seq) FROM perspective_log QUALIFY row_number() OVER (
      PARTITION BY agent_id, node_id, context_id ORDER BY updated_at DESC, seq DESC) = 1""",
    "associations": """SELECT agent_id, source_id, target_id, relation, weight FROM (
      SELECT 's' || l_suppkey AS agent_id, 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id,
             l_returnflag AS relation, 1 - 20 * l_discount AS weight, l_orderkey * 100 + ordinal AS seq FROM lines)
      QUALIFY row_number() OVER (PARTITION BY agent_id, source_id, target_id, relation ORDER BY seq DESC) = 1""",
    "operations": """SELECT event_id AS id, event_type AS op_type, 'p' || json_extract_string(props, '$.k') AS node_id,
      'u' || user_id AS author, event_id + 1 AS lamport_ts,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS author_seq, props AS payload, value,
      ts AS created_at FROM events""",
    "ledger": """SELECT CASE WHEN l_linenumber <> 1 THEN 'c' || o_custkey END AS from_wallet,
      's' || l_suppkey AS to_wallet, round(l_extendedprice * 100)::BIGINT AS amount, l_returnflag AS reason,
      l_orderkey * 100 + ordinal AS timestamp FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "balances": """SELECT wallet, sum(received)::BIGINT AS received, sum(sent)::BIGINT AS sent,
      (sum(received) - sum(sent))::BIGINT AS balance FROM (
        SELECT to_wallet AS wallet, amount AS received, 0 AS sent FROM ledger
        UNION ALL SELECT from_wallet, 0, amount FROM ledger WHERE from_wallet IS NOT NULL) GROUP BY wallet""",
    "test_results": """SELECT event_id AS id, event_type AS task_id, 'u' || user_id AS agent_id, value < 50 AS passed,
      round(value * 10)::INTEGER AS duration_ms, ts AS created_at FROM events""",
    "tasks": """SELECT event_type AS id, 'do ' || event_type AS description, 'running' AS status, 'u1' AS swarm_id,
      min(ts) AS created_at FROM events GROUP BY event_type
      UNION ALL SELECT 'idle', 'do nothing', 'pending', NULL, min(ts) FROM events""",
    "auctions": """SELECT p_partkey AS id, 'parts.p' || p_partkey AS scope, 's' || (p_partkey % 10) AS seller_wallet,
      round(p_retailprice * 100)::BIGINT AS current_price, floor(round(p_retailprice * 100) / 2)::BIGINT AS floor_price,
      greatest(floor(round(p_retailprice * 100) / 20)::BIGINT, 1) AS price_decrement, p_partkey % 3 + 1 AS min_bidders,
      CASE WHEN p_partkey % 5 = 0 THEN 'settled' WHEN p_partkey % 7 = 0 THEN 'open_sourced' ELSE 'active' END AS status,
      p_size AS open_delay_hours FROM part""",
    "bids": """SELECT l_partkey AS auction_id, 'c' || o_custkey AS bidder_wallet,
      round(l_extendedprice / l_quantity * 100)::BIGINT AS max_price, l_orderkey * 100 + ordinal AS seq
      FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "document_nodes": """
      SELECT 'd' || doc_id AS id, 'document' AS kind, lang AS language, source AS content, NULL AS parent_id,
             0 AS position, 'd' || doc_id AS path, '{"line_count":' || len(string_split(text, chr(10))) || '}' AS metadata
             FROM documents
      UNION ALL SELECT 'd' || doc_id || '_' || line, 'paragraph', lang, content, 'd' || doc_id, line,
             'd' || doc_id || '.d' || doc_id || '_' || line, '{}'
      FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS content,
                   (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line FROM documents)
      WHERE content <> ''""",
}


def sql(body: str) -> str:
    """``body`` preceded by the model tables that it names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.I):
                need(TABLES[name])
                needed.append(name)

    need(body)
    tables = [f"{name} AS ({TABLES[name]})" for name in needed]
    body = body.strip()
    recursive = ""
    if found := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        recursive, rest = found[1] or "", body[found.end() :]
        return f"WITH {recursive}" + ", ".join([*tables, rest])
    return ("WITH " + ", ".join(tables) + " " if tables else "") + body


# Stop words and Porter's endings, written here again so that the code is checked against them.
STOPS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
  itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
  had having do does did doing a an the and but if or because as until while of at by for with about against between into
  through during before after above below to from up down in out on off over under again further then once here there when
  where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
  don should now""".split()
SECOND = """ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate
  ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log""".split()
THIRD = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
DOUBLES = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx")


def _shape(word: str) -> str:
    """A word's letters as c and v: a y after a c is a v, as in the published definition."""
    return f"""regexp_replace(regexp_replace(regexp_replace({word}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g'), '(^|v)y', '\\1c', 'g')"""


def _steps_sql() -> str:
    """stems AS (word, term) of words AS (word), a step of Porter's a table."""
    def shape(x: str) -> str:
        return f"replace({_shape(x)}, 'y', 'v')"

    def measure(x: str, least: int) -> str:
        return f"regexp_matches({shape(x)}, 'v+c{'.*v+c' * (least - 1)}')"

    def vowel(x: str) -> str:
        return f"contains({shape(x)}, 'v')"

    def short(x: str) -> str:
        return f"(regexp_matches({shape(x)}, '^c+vc$') AND NOT regexp_matches({x}, '[wxy]$'))"

    def table(name: str, before: str, cut: str, then: str) -> str:
        return f"""{name}a AS (SELECT word, w, regexp_extract(w, '^(.+?)({cut})$', 1) AS s, regexp_extract(w, '^(.+?)({cut})$', 2) AS e FROM {before}),
  {name} AS (SELECT word, {then} AS w FROM {name}a)"""

    def mapped(name: str, before: str, pairs: list[str]) -> str:
        keys = "|".join(p.split(":")[0] for p in pairs)
        whens = " ".join("WHEN '{}' THEN '{}'".format(*p.split(":")) for p in pairs)
        return table(name, before, keys, f"CASE WHEN e <> '' AND {measure('s', 1)} THEN s || CASE e {whens} END ELSE w END")

    fourth = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize"
    mended = f"""CASE WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN regexp_matches(s, '({DOUBLES})$') THEN left(s, length(s) - 1)
      WHEN {short('s')} THEN s || 'e' ELSE s END"""
    return ", ".join([
        "w0 AS (SELECT word, word AS w FROM words)",
        table("w1", "w0", "s", "CASE WHEN regexp_matches(w, '(ss|i)es$') AND length(w) > 4 OR regexp_matches(w, '.sses$|.ies$') THEN left(w, length(w) - 2) "
              "WHEN e = '' OR right(s, 1) = 's' OR length(s) < 2 THEN w ELSE s END"),
        table("w2", "w1", "eed|ed|ing", f"CASE WHEN e = '' THEN w WHEN e = 'eed' THEN CASE WHEN {measure('s', 1)} THEN s || 'ee' ELSE w END "
              f"WHEN {vowel('s')} THEN {mended} ELSE w END"),
        table("w3", "w2", "y", f"CASE WHEN e <> '' AND {vowel('s')} THEN s || 'i' ELSE w END"),
        mapped("w4", "w3", SECOND),
        mapped("w5", "w4", THIRD),
        table("w6", "w5", fourth, f"""CASE WHEN e <> '' THEN CASE WHEN {measure('s', 2)} THEN s ELSE w END
          WHEN regexp_matches(w, '.[st]ion$') AND {measure('left(w, length(w) - 3)', 2)} THEN left(w, length(w) - 3) ELSE w END"""),
        table("w7", "w6", "e", f"""CASE WHEN e <> '' AND ({measure('s', 2)} OR ({measure('s', 1)} AND NOT {short('s')})) THEN s ELSE w END"""),
        f"stems AS (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN w LIKE '%ll' AND {measure('w', 2)} THEN left(w, length(w) - 1) ELSE w END AS term FROM w7)",
    ])


def ranked_sql(table: str, query: str, where: str = "true") -> str:
    """(id, rank) of the rows of ``table`` that hold all terms of ``query``, in SQL."""
    stops = ", ".join(f"'{w}'" for w in STOPS)
    split = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""(WITH placed AS (SELECT id, unnest({split.format('content')}) AS word, generate_subscripts({split.format('content')}, 1) AS place FROM {table} WHERE {where}),
      asked AS (SELECT DISTINCT unnest({split.format(f"'{query}'")}) AS word),
      words AS (SELECT word FROM (SELECT word FROM placed UNION SELECT word FROM asked) WHERE word NOT IN ({stops})), {_steps_sql()},
      wanted AS (SELECT DISTINCT term FROM asked JOIN stems USING (word)),
      held AS (SELECT id, term, least(place, 16383) AS place, row_number() OVER (PARTITION BY id, term ORDER BY place) AS k
        FROM placed JOIN stems USING (word) WHERE term IN (SELECT term FROM wanted)),
      full_ids AS (SELECT id FROM held GROUP BY id HAVING count(DISTINCT term) = (SELECT count(*) FROM wanted)),
      single AS (SELECT id, 0.1 / 1.64493406685 * sum(1.0 / (k * k)) AS rank FROM held WHERE k <= 255 GROUP BY id),
      pairs AS (SELECT a.id, exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN abs(a.place - b.place) BETWEEN 1 AND 100
          THEN 1 / (1.005 + 0.05 * exp(abs(a.place - b.place) / 1.5 - 2)) ELSE 1e-30 END)))) AS missed
        FROM held a JOIN held b ON a.id = b.id AND a.term < b.term WHERE a.k <= 255 AND b.k <= 255 GROUP BY a.id)
    SELECT f.id, round(CASE WHEN (SELECT count(*) FROM wanted) = 1 THEN s.rank ELSE 1 - missed END, 6) AS rank
    FROM full_ids f JOIN single s USING (id) LEFT JOIN pairs p USING (id))"""
