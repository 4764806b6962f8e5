"""DuckDB counterparts of those queries that SQL can express.

The others are held against plain Python in ``tests/llm``: tokenizers, rolling hashes, hundreds of license patterns, markup
and trained weights are beyond SQL.
"""

from __future__ import annotations

from tillstone.llm.quality import NOTICES

CAPITALS = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""
with words as (
    select doc_id, regexp_extract_all({CAPITALS.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from words
), items as (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
    select a.doc_id as a, b.doc_id as b
    from items a join items b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached as (
    with recursive r as (
        select doc_id as a, doc_id as b from sets union select r.a, links.b from r join links on r.b = links.a
    ) select a, min(b) as least from r group by a
)
select doc_id, len(s)::bigint as n_shingles, least as component_id, doc_id = least as kept
from sets join reached on a = doc_id
"""

WORDS = f"regexp_extract_all({CAPITALS.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS = f"""
with items as (
    select item_id, {WORDS} as w from benchmark
), windows as (
    select distinct item_id, least(10, len(w)) as size, unnest(list_transform(
        range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as window_text
    from items where len(w) > 0
), docs as (
    select doc_id, coalesce({WORDS}, []) as w from documents
), starts as (
    select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as first_at
    from docs, (select distinct size from windows) where len(w) >= size
), hits as (
    select s.doc_id, s.first_at, s.size, v.item_id
    from starts s join windows v on v.size = s.size and v.window_text = array_to_string(s.w[s.first_at:s.first_at + s.size - 1], ' ')
), covered as (
    select doc_id, count(distinct place) as n_hit
    from (select doc_id, unnest(range(first_at, first_at + size)) as place from hits) group by doc_id
), named as (
    select doc_id, list_sort(list(distinct item_id::varchar)) as names from hits group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(names), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join named using (doc_id)
"""

QUALITY = f"""
with docs as (
    select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, string_split(t, chr(10)) as lines
    from (select doc_id, coalesce(text, '') as t from documents)
), windows as (
    select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (
        select doc_id, w, unnest(range(1, len(w) - 3)) as i from docs)
), twice as (
    select doc_id, i, count(*) over (partition by doc_id, g) as n from windows
), repeated as (
    select doc_id, count(distinct place) as n_repeat_words
    from (select doc_id, unnest(range(i, i + 5)) as place from twice where n > 1) group by doc_id
), lines as (
    select doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words,
        len(regexp_extract_all(line, '\\||»|›|•| > | / ')) as separators,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols
    from (select doc_id, unnest(lines) as line from docs)
), lost as (
    select doc_id, sum(words) as n_lost_words from lines
    where words > 0 and (separators >= 2 and words <= 4 * (separators + 1)
        or words <= 12 and regexp_matches(lower(line), '{"|".join(NOTICES)}')
        or symbols >= 3 and symbols > 0.3 * words
        or words >= 30 and not regexp_matches(line, '[.!?:;")\\]'']|[“-‟…]|。|[！？]'))
    group by doc_id
), measured as (
    select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
            - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lost_words, 0)::bigint as n_lost_words
    from docs left join repeated using (doc_id) left join lost using (doc_id)
)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_lost_words <= 0.5 * n_words as kept
from measured
"""

URLS = f"""
with rules(verdict, host, path) as (
    values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rest as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), urls as (
    select page_id, {CAPITALS.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} as host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
    from rest
), best as (
    select u.page_id, max({{'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}}) as r
    from urls u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
    group by u.page_id
)
select page_id, host, path, r.rule as rule, coalesce(r.verdict, 'allow') as verdict from urls left join best using (page_id)
"""

#: The register of a reflected CRC-32 before its last inversion, bit by bit, over the digits of a number.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split({0}::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda r, z: xor(r >> 1, (r & 1) * 3988292384))))"""


def _hashed(fields: list[str]) -> str:
    parts = (f"coalesce(strlen(({one})::varchar)::varchar || ':' || ({one})::varchar, '-')" for one in fields)
    return f"sha256({' || '.join(parts)})"


def _levels(name: str, start: str) -> str:
    """Every node of the trees over ``start`` (tree, pos, node), ``n`` being the nodes of its level."""
    return f"""{name}(tree, level, pos, node, n) as (
    select tree, 0, pos, node, count(*) over (partition by tree) from {start}
    union all
    select tree, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), any_value((n + 1) // 2)
    from {name} where n > 1 group by tree, level, pos // 2
)"""


def _steps(nodes: str, start: str, place: str, base: str) -> str:
    """For every leaf and level of its tree: the place in the run and the sibling, if any."""
    return f"""select a.leaf_no, {base} + m.level as step, ({place} >> m.level) & 1 as side, s.node as sibling
    from {start} a join (select distinct tree, level from {nodes} where n > 1) m using (tree)
    left join {nodes} s on s.tree = m.tree and s.level = m.level and s.pos = xor({place} >> m.level, 1)"""


MERKLE = f"""
with recursive leaves as (
    select doc_id, lang, {_hashed(["doc_id", "source", "lang", "n_chars", "text"])} as leaf,
        case when n_chars is not null and {CRC32.format("doc_id")} % 7 = 0
            then {_hashed(["doc_id", "source", "lang", "n_chars::hugeint + 1", "text"])} end as other
    from documents
), placed as (
    select *, dense_rank() over (order by lang nulls first) - 1 as tree,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
        row_number() over () as leaf_no
    from leaves
), own_leaves as (
    select tree, pos, leaf as node from placed
), {_levels("own", "own_leaves")}, subroots as (
    select 0::bigint as tree, tree as pos, node from own where n = 1
), {_levels("top", "subroots")}, whole as (
    select p.*, h.height, s.node as subroot, r.node as root
    from placed p join (select tree, max(level) as height from own group by tree) h on h.tree = p.tree
    join subroots s on s.pos = p.tree cross join (select node from top where n = 1) r
), tops as (
    select leaf_no, 0::bigint as tree, tree as place, height from whole
), steps as (
    {_steps("own", "whole", "a.pos", "0")}
    union all
    {_steps("top", "tops", "a.place", "a.height")}
), folded(leaf_no, step, node) as (
    select leaf_no, 0, coalesce(other, leaf) from whole
    union all
    select f.leaf_no, f.step + 1, sha256(case when s.side = 1 then s.sibling || f.node else f.node || coalesce(s.sibling, '') end)
    from folded f join steps s on s.leaf_no = f.leaf_no and s.step = f.step
), proofs as (
    select leaf_no, string_agg(sibling, '' order by step) as siblings from steps group by leaf_no
), ends as (
    select leaf_no, arg_max(node, step) as folded_root from folded group by leaf_no
)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = root as verified
from whole join ends using (leaf_no) left join proofs using (leaf_no)
"""


def _codes_round(at: int) -> str:
    return f"""codes{at} as materialized (
    select vec_no, part, min(row(d, entry)) as best from (
        select v.vec_no, v.part, b.entry, coalesce(list_sum(list_transform(
            range(1, len(v.p) + 1), lambda i: (v.p[i] - b.e[i]) * (v.p[i] - b.e[i]))), 0)::bigint as d
        from parts v join books{at} b on b.part = v.part
    ) group by vec_no, part
), moved{at} as (
    select part, entry, list((s - ((s % n) + n) % n) // n order by place) as e from (
        select c.part, c.best[2] as entry, t.place, sum(t.x)::hugeint as s, count(*) as n
        from codes{at} c join (select vec_no, part, unnest(p) as x, unnest(range(len(p))) as place from parts) t
            on t.vec_no = c.vec_no and t.part = c.part
        group by c.part, c.best[2], t.place
    ) group by part, entry
), books{at + 1} as materialized (
    select b.part, b.entry, coalesce(m.e, b.e) as e from books{at} b left join moved{at} m on m.part = b.part and m.entry = b.entry
), """


CODES = f"""
with kept as (
    select row_number() over (order by vec_id nulls last) as vec_no, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
    select vec_no, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as p from kept, range(4) r(part)
), books0 as materialized (
    select part, vec_no - 1 as entry, p as e from parts where vec_no <= 256
), {"".join(map(_codes_round, range(5)))[:-2]}, coded as (
    select vec_no, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error
    from codes4 group by vec_no
), book as (
    select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as codebooks_sha256 from books4
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded using (vec_no) cross join book
"""

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": NEAR_DEDUP,
    "op3_leaks": LEAKS,
    "op7_quality": QUALITY,
    "op8_urls": URLS,
    "op12_merkle": MERKLE,
    "op13_codes": CODES,
}
