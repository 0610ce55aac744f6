"""DuckDB SQL for the queries that SQL can express."""

_BLOCK = "html|body|nav|ul|ol|li|div|article|section|main|header|footer|h[1-6]|p|br|table|tr|td|th"


def _page_text() -> str:
    text = "html"
    for pattern, to in [
        ("(?is)<head.*?</head>", ""), ("(?is)<script.*?</script>", ""),
        ("(?is)<style.*?</style>", ""), ("(?s)<!--.*?-->", ""),
        (f"(?i)</?({_BLOCK})(\\s[^>]*)?/?>", " "), ("<[^>]*>", ""),
    ]:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    for entity, char in [("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")]:
        text = f"replace({text}, '&{entity};', '{char}')"
    return f"trim(regexp_replace({text}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


def _urn(text: str) -> str:
    h = f"md5({text})"
    parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


def _line(name: str, value: str) -> str:
    return f"case when length({value}) > 0 then '{name}: ' || {value} || chr(13) || chr(10) else '' end"


def _op2(depth: int = 8) -> str:
    """Templates of paths of up to ``depth`` segments."""
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]
    rule = verdict = "case"
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')"
        rule, verdict = f"{rule} {fits} then '{text}'", f"{verdict} {fits} then '{kind}'"
    ctes = [
        """rests as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages)""",
        """hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) as h from rests)""",
        """paths as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) as path from hosts)""",
        f"""judged as (select *, regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{8}}[0-9a-fA-F-]{{8,}}', '{{h}}', 'g'),
            '[0-9]+', '{{n}}', 'g') as general, {rule} end as rule, {verdict} end as by_rule from paths)""",
        """tree0 as (select host, general, list_filter(string_split(general, '/'), lambda x: x <> '') as segments,
            count(*) as n, count(*) filter (where by_rule = 'allow') as n_allow,
            count(*) filter (where by_rule = 'block') as n_block, '' as template from judged group by host, general)""",
    ]
    for d in range(depth):
        ctes += [
            f"""child{d} as (select host, template, segments[{d + 1}] as segment, sum(n) as n, sum(n_allow) as n_allow,
                sum(n_block) as n_block from tree{d} where len(segments) > {d} group by all)""",
            f"""node{d} as (select host, template, count(*) as children, sum(n) as urls, sum(n_block) as all_block,
                sum(n_allow + n_block) as labelled from child{d} group by all)""",
            f"""share{d} as (select c.*, children, urls, n_allow + n_block as own,
                case when labelled > 0 then all_block::double / labelled end as share
                from child{d} c join node{d} using (host, template))""",
            f"""branch{d} as (select host, template, segment, case when children > 1 and (case when own >= 10
                then not coalesce(abs(n_block::double / own - share) > 2.0 * sqrt(share * (1 - share) / own), false)
                else n < 0.03125::double * urls end) then '*' else segment end as branch from share{d})""",
            f"""tree{d + 1} as (select t.host, t.general, t.segments, t.n, t.n_allow, t.n_block,
                case when branch is null then t.template else t.template || '/' || branch end as template
                from tree{d} t left join branch{d} b
                on b.host = t.host and b.template = t.template and b.segment = t.segments[{d + 1}])""",
        ]
    return "with " + ",\n".join(ctes) + f""",
    base as (select coalesce(sum(n_allow)::double / nullif(sum(n_allow + n_block), 0), 1.0) as base from tree{depth}),
    wide as (select template, (sum(n_allow) + 5.0::double * any_value(base)) / (sum(n_allow + n_block) + 5.0::double) as wide
        from tree{depth} cross join base group by template),
    here as (select host, template, (sum(n_allow) + 5.0::double * any_value(wide)) / (sum(n_allow + n_block) + 5.0::double) as purity
        from tree{depth} join wide using (template) group by host, template)
    select page_id, j.host, path, rule, coalesce(by_rule, case when purity < 0.5 then 'block' else 'allow' end) as verdict,
        h.template, purity
    from judged j join tree{depth} t on t.host = j.host and t.general = j.general
    join here h on h.host = t.host and h.template = t.template"""


OP2 = _op2()

OP4 = f"""
with source as (
    select page_id, url, html, {_urn("'page-' || page_id")} as source_id, {_page_text()} as body from pages),
described as (
    select *, {_urn("source_id || '#conversion'")} as conversion_id,
        trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\f\\r]+', ' ', 'g')) as title,
        regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) as lang,
        regexp_extract(html, '(?i)<meta[^>]*charset="?([A-Za-z0-9_-]+)', 1) as charset,
        'sha256:' || sha256(html) as html_digest, cast(strlen(html) as varchar) as html_length,
        'sha256:' || sha256(body) as body_digest
    from source),
about as (
    select *, {" || ".join(_line(n, v) for n, v in [
        ("title", "title"), ("language", "lang"), ("charset", "charset"),
        ("source-payload-digest", "html_digest"), ("source-payload-length", "html_length"),
        ("conversion-record-id", "conversion_id"), ("conversion-block-digest", "body_digest")])}
        || 'source-warc: WARC-Payload-Digest: md5:' || md5(html) || chr(13) || chr(10)
        || 'source-warc: WARC-Type: response' || chr(13) || chr(10)
        || 'source-http: HTTP/1.1 200 OK' || chr(13) || chr(10)
        || 'source-http: Content-Type: text/html' || chr(13) || chr(10)
        || list_aggregate(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1),
            lambda x: 'outlink: ' || x || chr(13) || chr(10)) || [''], 'string_agg', '') as fields
    from described),
records as (
    select source_id, url, 'metadata' as warc_type, {_urn("source_id || '#metadata'")} as record_id,
        'application/warc-fields' as content_type, fields as block from about
    union all
    select source_id, url, 'conversion', conversion_id, 'text/plain; charset=utf-8', body from about)
select source_id as refers_to, warc_type, record_id, url as target_uri, content_type,
    cast(strlen(block) as bigint) as content_length, 'sha256:' || sha256(block) as block_digest
from records
"""

OP5 = r"""
with recursive low as (
    select conv_id, turn, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from conversations),
texts as (
    select conv_id, turn, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from conversations group by all),
mail as (
    select c.conv_id, c.turn, c.text, a.w as w1, b.w as w2, regexp_extract_all(c.t, '[^\x20\x09-\x0D]+') as w0,
        list_transform(string_split(c.t, chr(10)), lambda x: regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as own,
        list_transform(range(1, len(a.w) + 1, 9), lambda i: a.w[i : i + 8]) as lines1,
        list_transform(range(1, len(b.w) + 1, 9), lambda i: b.w[i : i + 8]) as lines2
    from low c
    left join texts a on a.conv_id = c.conv_id and a.turn = c.turn - 1
    left join texts b on b.conv_id = c.conv_id and b.turn = c.turn - 2),
passages as (
    select conv_id, turn, unnest([{'level': 0, 'w': w0, 'lines': own}, {'level': 1, 'w': w1, 'lines': lines1},
        {'level': 2, 'w': w2, 'lines': lines2}]) as p from mail),
parted as (
    select conv_id, turn, p.level as level, p.w as w, p.lines as lines,
        list_filter(range(1, len(p.w) + 1), lambda i: i = 1 or starts_with(md5(p.w[i - 1]), '0')) as starts
    from passages where len(p.w) > 0),
pieces as (
    select conv_id, turn, level, unnest(list_distinct(
        list_transform(range(1, len(starts) + 1),
            lambda k: array_to_string(w[starts[k] : coalesce(starts[k + 1] - 1, len(w))], ' '))
        || case when level = 0 or len(starts) = 1
            then list_transform(list_filter(lines, lambda x: len(x) > 0), lambda x: array_to_string(x, ' ')) else [] end)) as piece
    from parted),
linked as (
    select q.conv_id, q.turn, q.level, q.piece, q.n, max(o.turn) as origin
    from (select conv_id, turn, level, piece, count(*) as n from pieces where level > 0 group by all) q
    join (select distinct conv_id, turn, piece from pieces where level = 0) o
    on o.conv_id = q.conv_id and o.piece = q.piece and o.turn < q.turn
    group by all),
votes as (select conv_id, turn, level, origin, sum(n) as n from linked group by all),
answers as (
    select conv_id, turn, first(origin order by level, n desc, origin desc) as reply_to, sum(n) as n_linked
    from votes group by all),
ways as (
    select conv_id, turn, reply_to as up, 1 as depth from answers
    union all
    select w.conv_id, w.turn, a.reply_to, w.depth + 1
    from ways w join answers a on a.conv_id = w.conv_id and a.turn = w.up),
threads as (select conv_id, turn, min(up) as thread, max(depth) as depth from ways group by all)
select m.conv_id, m.turn, a.reply_to, coalesce(t.thread, m.turn) as thread,
    cast(coalesce(t.depth, 0) as bigint) as depth,
    cast(coalesce(ceil(len(m.w1) / 9), 0) + coalesce(ceil(len(m.w2) / 9), 0) as bigint) as n_quoted,
    cast(coalesce(a.n_linked, 0) as bigint) as n_linked,
    md5(coalesce(m.text, '')) as text_md5
from mail m
left join answers a on a.conv_id = m.conv_id and a.turn = m.turn
left join threads t on t.conv_id = m.conv_id and t.turn = m.turn
"""

OP6 = r"""
with texts as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from texts),
windows as (
    select doc_id, i, array_to_string(w[i : i + 34], ' ') as win
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from texts)),
recurring as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by win) as n from windows) where n > 1),
covered as (select distinct doc_id, unnest(range(i, i + 35)) as p from recurring),
kept as (
    select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
    from words anti join covered using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
    sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join kept using (doc_id)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10 = f"""
with texts as (select doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
item_windows as (
    select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win
    from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
        from items where len(w) > 0)),
windows as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from texts cross join (select distinct n from item_windows))),
found as (select doc_id, i, n, item_id from windows join item_windows using (n, win)),
hits as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(20 * n_hit >= len(w), false) as contaminated
from texts left join hits using (doc_id) left join named using (doc_id)
"""


OP11 = """
with recursive vectors as (
    select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    where embedding is not null and label is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b
    from vectors a join vectors b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reach r join links l on l.a = r.b),
named as (select a as vec_id, min(b) as component_id from reach group by a),
counted as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from named left join counted using (vec_id)
"""

_SPACE = r"[^\x20\x09-\x0D]+"

OP13 = rf"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
firsts as (select text, min(doc_id) as first from texts group by text),
known as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as bad
    from labels group by doc_id),
judged as (
    select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
        cast(len(w) < 200 as int)
        + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
        + 4 * cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as int)
        + 8 * cast(regexp_matches(text, '[#$%&*|]') as int)
        + 16 * cast(doc_id > first as int) as failed
    from texts join firsts using (text) left join known using (doc_id)),
patterns as (
    select part, failed, count(*) as n, sum(good) as good, sum(bad) as bad from judged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
    select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
    select filter_order, step, bits[step] as bit, list_sum([0] || bits[1 : step - 1]) as before
    from orders, (select unnest(range(1, 6)) as step)),
done as (
    select part, filter_order, step, bit,
        sum(case when failed & (before | bit) = 0 then n else 0 end) as kept,
        sum(case when failed & bit > 0 and failed & before = 0 then n else 0 end) as removed,
        sum(case when failed & bit > 0 and failed & before > 0 then n else 0 end) as redundant,
        sum(case when failed = bit then n else 0 end) as unique_fails,
        sum(case when failed & bit > 0 and failed & before = 0 then good else 0 end) as good_lost,
        sum(case when failed & bit > 0 and failed & before = 0 then bad else 0 end) as toxic_lost
    from patterns, (select filter_order, step, bit, cast(before as int) as before from steps) group by all)
select part, filter_order, cast(step as int) as step, {", ".join(f"cast({c} as bigint) as {c}" for c in
    "kept removed redundant unique_fails good_lost toxic_lost".split())},
    cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from done
"""
