"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import hashlib

from rastrel.llm import lines, search, secrets, sharding


def _claimed(shards: int, slots: int) -> list[int]:
    """The lookup table by the plain rule: each shard in turn takes the first slot of its list that is still free."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    lists = []
    for name in sharding.shard_names(shards):
        at, skip = number(f"offset:{name}") % slots, number(f"skip:{name}") % (slots - 1) + 1
        lists.append(iter([(at + k * skip) % slots for k in range(slots)]))
    owner: dict[int, int] = {}
    while len(owner) < slots:
        for shard, wanted in enumerate(lists):
            for slot in wanted:
                if slot not in owner:
                    owner[slot] = shard
                    break
            if len(owner) == slots:
                break
    return [owner[s] for s in range(slots)]


def sharding_sql() -> str:
    table = ",".join(map(str, _claimed(sharding.SHARDS, sharding.SLOTS)))
    return f"""WITH claimed AS (SELECT string_split('{table}', ',') AS shards),
  placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
  SELECT doc_id, slot, CAST(shards[slot + 1] AS INT) AS shard FROM placed, claimed"""


def secrets_sql() -> str:
    """Places by running sums over what a split leaves between matches, and links by joining spans on nearness."""
    parts = []
    for n, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        text = pattern.replace("'", "''")
        mixed = " AND regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[A-Za-z]')" if kind == "weak_secret" else ""
        parts.append(f"""SELECT row, {n} AS kind, place, len, sum(length(gap) + len) OVER (PARTITION BY row ORDER BY place) AS stop, length(value) >= {least}{mixed} AS fits FROM (
      SELECT row, unnest(range(1, len(wholes) + 1)) AS place, unnest(wholes) AS whole, unnest(found) AS value, unnest(gaps[:len(wholes)]) AS gap, length(whole) AS len FROM (
      SELECT row, regexp_extract_all(text, '{text}', 0) AS wholes, regexp_extract_all(text, '{text}', {group}) AS found, regexp_split_to_array(text, '{text}') AS gaps FROM docs))""")
    kinds = {k: n for n, k in enumerate(secrets.KINDS)}
    near = lambda *names: f"EXISTS (SELECT 1 FROM spans o WHERE o.row = s.row AND o.kind IN ({', '.join(str(kinds[n]) for n in names)}) AND o.start BETWEEN s.start - {secrets.SCOPE} AND s.start + {secrets.SCOPE})"
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), parts AS ({" UNION ALL ".join(parts)}),
  spans AS (SELECT row, kind, CAST(stop - len AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM parts WHERE fits),
  told AS (SELECT * FROM spans s WHERE kind < {secrets.BASE} OR (NOT EXISTS (SELECT 1 FROM spans o WHERE o.row = s.row AND o.kind < {secrets.BASE} AND (o.start, o.kind) < (s.start, s.kind) AND o.stop > s.start) AND (
    (kind = {kinds["weak_id"]} AND {near("assign", "hex", "weak_secret")}) OR (kind = {kinds["weak_secret"]} AND {near("access", "weak_id")})
    OR (kind = {kinds["endpoint"]} AND {near("access", "weak_id")} AND {near("assign", "hex", "weak_secret")})))),
  lists AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind >= {secrets.BASE}) AS d,
    string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {secrets.BASE}) AS base, string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS every FROM told GROUP BY row)
  SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(d, 0) AS n_linked FROM docs LEFT JOIN lists USING (row)"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def lines_sql() -> str:
    blank = " || ".join(f"chr({b})" for b in lines.BLANK)
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, CASE WHEN doc_id IS NULL THEN coalesce(text, '') END AS own FROM documents),
  parts AS (SELECT row, doc_id, own, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM docs),
  keyed AS (SELECT *, translate(trim(line, {blank}), {_LETTERS}) AS key FROM parts),
  repeated AS (SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= {lines.LEAST} GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT own) > 1),
  told AS (SELECT k.*, r.key IS NOT NULL AND doc_id IS DISTINCT FROM low AS lost FROM keyed k LEFT JOIN repeated r USING (key))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
  FROM told GROUP BY row, doc_id"""


def search_sql() -> str:
    terms = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {terms("text")} AS terms FROM documents),
  long AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0), totals AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM long),
  each AS (SELECT row, unnest(terms) AS term FROM docs), tfs AS (SELECT row, term, count(*) AS tf FROM each GROUP BY row, term), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
  wanted AS (SELECT row_number() OVER () AS item, item_id, list_distinct({terms("text")}) AS terms FROM benchmark), asked AS (SELECT item, item_id, unnest(terms) AS term FROM wanted),
  scored AS (SELECT item, item_id, row, any_value(doc_id) AS doc_id, CAST(sum(CAST(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_) // L_)))) AS BIGINT) AS score
    FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN long USING (row), totals GROUP BY item, item_id, row),
  placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
  SELECT * FROM placed WHERE rank <= {search.BEST}"""


ORACLES = {
    "op1_multipart_secrets": secrets_sql(),
    "op6_permutation_sharding": sharding_sql(),
    "op11_bloom_lines": lines_sql(),
    "op12_threshold_search": search_sql(),
}
