"""SQL of the text queries that SQL can express, for checking the Spark results with DuckDB."""

from __future__ import annotations

from .conversation_repair import DELETE, INSERT, KEEP, LOTS, REROLE, UNENDED
from .license_scan import PHRASES, SHARE, STEP, TEMPLATES
from .prefix_trie import _CODE, EVERY, OPENING
from .sharding import _DIGITS, OVERHEAD, SHARDS, SLICES

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def exact_dedup() -> str:
    return r"""WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
groups AS (
  SELECT bare, count(*) AS group_size,
         arg_min(doc_id, (-length(text), doc_id)) AS keep_id
  FROM plain GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
FROM plain JOIN groups USING (bare)"""


def _bid(shard: str) -> str:
    digits = f"substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || {shard}), 1, {_DIGITS})"
    return f"-ln((('0x' || {digits})::BIGINT + 0.5::DOUBLE) / {float(16**_DIGITS)!r}::DOUBLE)"


def _crc32(data: str) -> str:
    """The checksum of a blob byte by byte, with what eight steps of its polynomial make of a byte."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (value & 1) * 3988292384
        table.append(value)
    byte = f"xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])"
    codes = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


def sharding() -> str:
    def winner(shards: int) -> str:
        return f"list_min(list_transform(range({shards}), lambda s: {{'bid': {_bid('s')}, 'shard': s}})).shard"

    return f"""WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents),
sized AS (
  SELECT doc_id, octet_length(data) + {OVERHEAD} AS size,
         {_crc32("data")} AS text_crc32
  FROM bytes),
placed AS (
  SELECT *, {winner(SHARDS)} AS shard, {winner(SHARDS + 1)} AS grown_shard,
         ((coalesce(doc_id, 0) % {SLICES} + {SLICES}) % {SLICES} + text_crc32 % {SLICES}) % {SLICES} AS slice FROM sized)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM placed"""


def license_scan() -> str:
    columns, places, base, like = [], [], [], []
    for k, (phrase, label) in enumerate(PHRASES.items()):
        test = " AND ".join(f"words[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1))
        columns.append(f"list_filter(range(len(words)), lambda i: {test}) AS p{k}")
        places.append(f"p{k}")
        base.append(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END")
    shares = []
    for k, (label, text) in enumerate(TEMPLATES):
        wanted = sorted(set(text.split()))
        own = "[" + ", ".join(f"'{word}'" for word in wanted) + "]"
        block = f"len(list_intersect(list_distinct(words[i + 1:i + {2 * STEP}]), {own}))"
        columns.append(f"list_max(list_transform(range(0, greatest(len(words), 1), {STEP}), lambda i: {block})) AS t{k}")
        held = f"t{k} * {SHARE.denominator} >= {SHARE.numerator} * {len(wanted)}"
        like.append(f"CASE WHEN {held} THEN '{label}' END")
        shares.append(f"CASE WHEN {held} THEN t{k}::DOUBLE / {len(wanted)} ELSE 0 END")
    named = lambda labels: f"array_to_string(list_sort(list_distinct([{', '.join(labels)}])), ',')"
    every = f"list_concat({', '.join(places)})"
    return rf"""WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
found AS (SELECT doc_id, words, {', '.join(columns)} FROM split)
SELECT doc_id, len(words) AS n_words, len({every}) AS n_base,
       list_min({every}) AS first_word, list_max({every}) AS last_word,
       coalesce({named(base)}, '') AS base_labels, coalesce({named(base + like)}, '') AS labels,
       CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE greatest({', '.join(shares)})::DOUBLE END AS score
FROM found"""


def conversation_repair() -> str:
    """Rows are gone through one by one: ``w`` has the cheapest way to each state, cost before letters.

    The states are what stood last: nothing, system, user, assistant.  Neither of two ways of
    one cost to one state starts with the other, since an insert more costs more, so that
    the first by its letters so far is the first in the end.
    """
    far = "{'c': 1000000, 's': ''}"

    def add(way: str, cost: str | int, letter: str) -> str:
        return f"{{'c': {way}.c + {cost}, 's': {way}.s || '{letter}'}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    # Inserts before a row: into a user turn from any other state, then into an assistant turn.
    user = least("w.u", *(add(f"w.{state}", INSERT, "I") for state in "nsa"))
    inserted = f"{{'n': w.n, 's': w.s, 'u': {user}, 'a': {least('w.a', add('w.u', INSERT, 'I'), *(add(f'w.{x}', 2 * INSERT, 'II') for x in 'ns'))}}}"
    more = f"CASE WHEN fault = 3 THEN {UNENDED} ELSE 0 END"
    kept = f"({KEEP} + {more} + CASE WHEN fault IN (0, 3) THEN 0 ELSE 1000000 END)"
    changed = f"({REROLE} + {more} + CASE WHEN fault IN (0, 3) THEN 0 ELSE 1000000 END)"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN initial = '{initial}' THEN {add(f'v.{state}', kept, 'K')} ELSE {far} END"

    delete = {state: add(f"v.{state}", DELETE, "D") for state in "nsua"}
    after = f"""{{'n': {delete['n']}, 's': {least(delete['s'], keep('n', 's'))},
      'u': {least(delete['u'], *(keep(x, 'u') for x in 'nsa'), *(add(f'v.{x}', changed, 'R') for x in 'nsa'))},
      'a': {least(delete['a'], keep('u', 'a'), add('v.u', changed, 'R'))}}}"""
    return rf"""WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % {LOTS} AS lot
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM lots),
ranked AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text
                            ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS seen
  FROM damaged),
rows AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ranked),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n,
         list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM rows GROUP BY conv_id),
ways AS (
  SELECT conv_id, 1 AS i, {{'n': {{'c': 0, 's': ''}}, 's': {far}, 'u': {far}, 'a': {far}}} AS w FROM counts
  UNION ALL
  SELECT conv_id, i + 1, {after}
  FROM (SELECT b.conv_id, b.i, r.initial, r.fault, {inserted} AS v
        FROM ways b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i)),
best AS (
  SELECT conv_id, {least("v.n", "v.a")} AS best FROM (
    SELECT b.conv_id, {inserted} AS v FROM ways b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n + 1)),
letters AS (
  SELECT b.conv_id, best.c AS cost, best.s AS audit, roles, texts, unnest(range(1, length(best.s) + 1)) AS k
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id),
edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS letter, length(replace(left(audit, k), 'I', '')) AS i,
         length(replace(left(audit, k), 'D', '')) AS place, roles, texts FROM letters),
turns AS (
  SELECT conv_id, place, letter, CASE WHEN letter = 'I' THEN '' ELSE texts[i] END AS text,
         CASE WHEN letter = 'K' THEN roles[i] END AS kept
  FROM edits WHERE letter <> 'D'),
fitted AS (
  SELECT *, CASE WHEN left(first_value(kept) OVER (PARTITION BY conv_id ORDER BY place), 1) = 's' THEN 1 ELSE 0 END AS system
  FROM turns),
repaired AS (
  SELECT conv_id, string_agg(coalesce(kept, CASE WHEN (place - 1 - system) % 2 = 1 THEN 'assistant' ELSE 'user' END) || ':' || text,
                             chr(10) ORDER BY place) AS whole
  FROM fitted GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.s, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def prefix_trie() -> str:
    return f"""WITH turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size,
         left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), {_CODE}) AS code
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, string_agg(code, '' ORDER BY turn NULLS FIRST, code) AS path,
         list(size ORDER BY turn NULLS FIRST, code) AS sizes, any_value({_crc32("encode(conv_id::VARCHAR)")}) % {OPENING} AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, coalesce(left(b.path, {_CODE} * o.h), '') || substr(o.path, {_CODE} * o.h + 1) AS path,
         list_concat(coalesce(b.sizes[1:o.h], []), o.sizes[o.h + 1:]) AS sizes
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {EVERY}),
prefixes AS (
  SELECT conv_id, path, sizes, unnest(range(length(path) // {_CODE} + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT left(path, {_CODE} * depth) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(any_value(sizes[depth]), 0) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length(path) = {_CODE} * depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
children AS (SELECT left(key, {_CODE} * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT left(key, {_CODE} * d) AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT key, saved, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(depth + 1)) AS d
        FROM nodes LEFT JOIN children USING (key)) GROUP BY 1)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(c.n, 0) AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN above USING (key) LEFT JOIN children c USING (key)
LEFT JOIN nodes p ON a.depth > 0 AND p.key = left(a.key, {_CODE} * (a.depth - 1))"""
