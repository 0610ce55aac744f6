"""DuckDB SQL that answers the registered queries."""

from __future__ import annotations

from queries_support import ALPHA, BETA, K, VOCAB_SIZE
from topicloom.functions.stem import STEP_1A, STEP_2, STEP_3, STEP_4, rule
from topicloom.functions.stopwords import STOP_WORDS

VOWELS = "('a','e','i','o','u')"


def _plain(w: str) -> str:
    """Consonant y as Y, vowel y as a.  RE2 has no look-ahead; runs of three y's suffice."""
    for pattern, to in [("y$", "Y"), ("y([aeiou])", r"Y\1"), ("yy([^aeiouyY])", r"Yy\1"),
                        ("yyY", "YyY"), ("y", "a")]:
        w = f"regexp_replace({w}, '{pattern}', '{to}', 'g')"
    return w


def _m(w: str) -> str:
    return f"len(regexp_extract_all({_plain(w)}, '[aeiou][^aeiou]'))"


def _vowel(w: str) -> str:
    return f"regexp_matches({_plain(w)}, '[aeiou]')"


def _cvc(w: str) -> str:
    middle = f"left(right({w}, 2), 1)"
    return f"(regexp_matches({_plain(w)}, '[^aeiou][aeiou][^aeiou]$') and {middle} <> 'y')"


def _double(w: str, but: str) -> str:
    last = f"right({w}, 1)"
    return (f"(length({w}) > 1 and {last} = left(right({w}, 2), 1) "
            f"and {last} not in {VOWELS} and {last} not in {but})")


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _case(rules: list[str], keep=lambda t, s: None) -> str:
    branches = []
    for suffix, replacement in map(rule, rules):
        t = _cut(len(suffix))
        condition = keep(t, suffix)
        extra = f" and {condition}" if condition else ""
        branches.append(f"when w like '%{suffix}'{extra} then {t} || '{replacement}'")
    return "case " + " ".join(branches) + " else w end"


def _stem_steps() -> list[str]:
    c = _cut(1)
    return [
        _case(STEP_1A),
        _case(["ed -", "ing -"], lambda t, s: _vowel(t)),
        f"""case when w not like '%-' then w
            when {c} like '%at' or {c} like '%bl' or {c} like '%iz' then {c} || 'e'
            when {_double(c, "('l','s','z')")} then {_cut(2)}
            when {_m(c)} = 1 and {_cvc(c)} then {c} || 'e' else {c} end""",
        _case(["y i"], lambda t, s: _vowel(t)),
        _case(STEP_2, lambda t, s: f"{_m(t)} > 0"),
        _case(STEP_3, lambda t, s: f"{_m(t)} > 0"),
        _case(STEP_4, lambda t, s: f"{_m(t)} > 1"
              + (f" and right({t}, 1) in ('s', 't')" if s == "ion" else "")),
        f"""case when w like '%e' and ({_m(c)} > 1 or ({_m(c)} = 1 and not {_cvc(c)}))
            then {c} else w end""",
        f"case when w like '%ll' and {_m('w')} > 1 then {c} else w end",
    ]


def _text_ctes() -> list[str]:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS))
    ctes = [
        """tok as (select doc_id, token from (select doc_id,
            unnest(string_split_regex(text, '[^a-zA-Z]+')) as token from documents)
            where token <> '')""",
        f"""cleaned as (select doc_id, lower(token) as token from tok
            where length(token) <= 32 and lower(token) not in ({stop}))""",
        "s0 as (select token, token as w, count(*) as n from cleaned group by token)",
    ]
    for i, step in enumerate(_stem_steps()):
        ctes.append(f"s{i + 1} as materialized (select token, n, {step} as w from s{i})")
    ctes.append(f"stems as (select token, w as stem, n from s{len(_stem_steps())})")
    return ctes


def _vocab_ctes() -> list[str]:
    return _text_ctes() + [
        """counts as (select stem as term, cast(sum(n) as bigint) as freq from stems
            where length(stem) between 3 and 14 group by stem)""",
        f"""vocab as materialized (select term, cast(row_number() over
            (order by freq desc, term) - 1 as integer) as term_id, freq
            from counts order by freq desc, term limit {VOCAB_SIZE})""",
    ]


def _dtf_ctes() -> list[str]:
    return _vocab_ctes() + [
        """dtf as materialized (select c.doc_id, v.term_id, cast(count(*) as integer) as tf
            from cleaned c join stems s using (token) join vocab v on v.term = s.stem
            group by c.doc_id, v.term_id)"""
    ]


def _model_ctes() -> list[str]:
    a, b = f"{ALPHA}::double", f"{BETA}::double"
    return _dtf_ctes() + [
        f"""occ as materialized (select doc_id, term_id,
            cast((doc_id + term_id + p) % {K} as integer) as topic, p
            from (select doc_id, term_id, unnest(range(tf)) as p from dtf))""",
        "nwk as materialized (select term_id, topic, count(*) as n from occ group by all)",
        "nk as (select topic, count(*) as n from occ group by topic)",
        "ndk as (select doc_id, topic, count(*) as n from occ group by all)",
        f"ks as (select cast(unnest(range({K})) as integer) as topic)",
        "width as (select count(*) as v from vocab)",
        f"""phi as materialized (select vocab.term_id, ks.topic,
            (coalesce(nwk.n, 0) + {b}) / (coalesce(nk.n, 0) + v * {b}) as prob
            from vocab cross join ks cross join width
            left join nwk on nwk.term_id = vocab.term_id and nwk.topic = ks.topic
            left join nk on nk.topic = ks.topic)""",
        f"""theta as materialized (select d.doc_id, ks.topic,
            (coalesce(ndk.n, 0) + {a}) / (d.n + {K} * {a}) as prob
            from (select doc_id, sum(tf) as n from dtf group by doc_id) d cross join ks
            left join ndk on ndk.doc_id = d.doc_id and ndk.topic = ks.topic)""",
    ]


def _sql(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def _hash(key: str) -> str:
    return f"cast('0x' || substr(md5({key}), 1, 8) as bigint)"


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
    return f"select page_id, trim(regexp_replace({text}, '[ \\t\\n\\f\\r]+', ' ', 'g')) as text from pages"


def _gibbs() -> str:
    a, b = f"{ALPHA}::double", f"{BETA}::double"
    return _sql(
        _model_ctes() + [
            """tokens as materialized (select doc_id, term_id, topic as z, row_number() over
                (partition by doc_id order by term_id, p) - 1 as pos from occ)""",
            f"""weights as (select t.doc_id, t.pos, t.term_id, ks.topic,
                (coalesce(ndk.n, 0) - (ks.topic = t.z)::int + {a})
                * (coalesce(nwk.n, 0) - (ks.topic = t.z)::int + {b})
                / (nk.n - (ks.topic = t.z)::int + v * {b}) as weight
                from tokens t cross join ks cross join width
                left join ndk on ndk.doc_id = t.doc_id and ndk.topic = ks.topic
                left join nwk on nwk.term_id = t.term_id and nwk.topic = ks.topic
                left join nk on nk.topic = ks.topic)""",
            """running as (select *, sum(weight) over (partition by doc_id, pos order by topic) as c,
                sum(weight) over (partition by doc_id, pos) as total from weights)""",
            f"""drawn as (select doc_id, pos, any_value(term_id) as term_id,
                least(count(*) filter (where c < total
                    * ({_hash("'42:0:' || doc_id || ':' || pos")} / 4294967296.0::double)), {K - 1})
                as topic from running group by doc_id, pos)""",
        ],
        "select term_id, cast(topic as integer) as topic, count(*) as n from drawn group by all",
    )


def _gibbs_sweeps(sweeps: int) -> str:
    """Sweeps with counts frozen within each and refreshed between them."""
    a, b = f"{ALPHA}::double", f"{BETA}::double"
    ctes = [
        """tokens0 as materialized (select doc_id, term_id, topic as z, row_number() over
            (partition by doc_id order by term_id, p) - 1 as pos from occ)"""
    ]
    for r in range(sweeps):
        ctes += [
            f"nwk{r} as materialized (select term_id, z as topic, count(*) as n from tokens{r} group by all)",
            f"nk{r} as materialized (select z as topic, count(*) as n from tokens{r} group by all)",
            f"ndk{r} as materialized (select doc_id, z as topic, count(*) as n from tokens{r} group by all)",
            f"""weights{r} as (select t.doc_id, t.pos, t.term_id, ks.topic,
                (coalesce(d.n, 0) - (ks.topic = t.z)::int + {a}) * (coalesce(w.n, 0) - (ks.topic = t.z)::int + {b})
                / (coalesce(n.n, 0) - (ks.topic = t.z)::int + v * {b}) as weight
                from tokens{r} t cross join ks cross join width
                left join ndk{r} d on d.doc_id = t.doc_id and d.topic = ks.topic
                left join nwk{r} w on w.term_id = t.term_id and w.topic = ks.topic
                left join nk{r} n on n.topic = ks.topic)""",
            f"""running{r} as (select *, sum(weight) over (partition by doc_id, pos order by topic) as c,
                sum(weight) over (partition by doc_id, pos) as total from weights{r})""",
            f"""tokens{r + 1} as materialized (select doc_id, pos, any_value(term_id) as term_id,
                cast(least(count(*) filter (where c < total
                    * ({_hash(f"'42:{r}:0:' || doc_id || ':' || pos")} / 4294967296.0::double)), {K - 1}) as integer)
                as z from running{r} group by doc_id, pos)""",
        ]
    body = f"select term_id, z as topic, count(*) as n from tokens{sweeps} group by all"
    return _sql(_model_ctes() + ctes, body)


def _em_ctes(iterations: int) -> list[str]:
    """Expectation maximisation from the counts of the deterministic state."""
    a, b = f"{ALPHA}::double", f"{BETA}::double"
    ctes = [
        "sizes as (select doc_id, sum(tf)::double as n from dtf group by doc_id)",
        """share0 as materialized (select d.doc_id, ks.topic, coalesce(x.n, 0)::double as n from sizes d cross join ks
            left join ndk x on x.doc_id = d.doc_id and x.topic = ks.topic)""",
        """word0 as materialized (select t.term_id, ks.topic, coalesce(x.n, 0)::double as n from vocab t cross join ks
            left join nwk x on x.term_id = t.term_id and x.topic = ks.topic)""",
    ]
    for r in range(iterations):
        ctes += [
            f"total{r} as (select topic, sum(n) as n from word{r} group by topic)",
            f"""mass{r} as materialized (select d.doc_id, d.term_id, d.tf, w.topic,
                (w.n + {b}) / (t.n + v * {b}) * (s.n + {a}) / (z.n + {K} * {a}) as mass
                from dtf d join word{r} w using (term_id) join total{r} t on t.topic = w.topic
                join share{r} s on s.doc_id = d.doc_id and s.topic = w.topic
                join sizes z on z.doc_id = d.doc_id cross join width)""",
            f"""mix{r} as materialized (select doc_id, term_id, any_value(tf) as tf, sum(mass) as mix
                from mass{r} group by all)""",
            f"""part{r} as materialized (select m.doc_id, m.term_id, m.topic, m.tf * m.mass / x.mix as n
                from mass{r} m join mix{r} x using (doc_id, term_id))""",
            f"share{r + 1} as materialized (select doc_id, topic, sum(n) as n from part{r} group by all)",
            f"word{r + 1} as materialized (select term_id, topic, sum(n) as n from part{r} group by all)",
        ]
    return _model_ctes() + ctes


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    series = f"(1/12::double - (1/120::double - (1/252::double - 1 / (240 * {y} * {y})) / ({y} * {y})) / ({y} * {y}))"
    behind = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return f"(ln({y}) - 1 / (2 * {y}) - {series} / ({y} * {y}) - ({behind}))"


def _online_steps(steps: int, rounds: int) -> str:
    a, b = f"{ALPHA}::double", f"{BETA}::double"
    ctes = [f"lambda0 as materialized (select term_id, topic, 1.0::double + ((term_id + topic) % {K}) / 10.0::double as x from vocab cross join ks)"]
    for t in range(steps):
        ctes += [
            f"total{t} as (select topic, sum(x) as x from lambda{t} group by topic)",
            f"""beta{t} as materialized (select l.term_id, l.topic, exp({_digamma("l.x")} - {_digamma("n.x")}) as b
                from lambda{t} l join total{t} n using (topic))""",
            f"gamma{t}_0 as (select doc_id, topic, 1.0::double as g from (select distinct doc_id from dtf) cross join ks)",
        ]
        for r in range(rounds + 1):
            ctes += [
                f"""share{t}_{r} as materialized (select g.doc_id, topic, exp({_digamma("g")} - {_digamma("whole")}) as s
                    from gamma{t}_{r} g join (select doc_id, sum(g) as whole from gamma{t}_{r} group by doc_id) using (doc_id))""",
                f"""part{t}_{r} as materialized (select doc_id, term_id, tf, topic, s * b as m
                    from dtf join beta{t} using (term_id) join share{t}_{r} using (doc_id, topic))""",
                f"norm{t}_{r} as materialized (select doc_id, term_id, sum(m) as norm from part{t}_{r} group by all)",
            ]
            if r < rounds:
                ctes.append(
                    f"""gamma{t}_{r + 1} as materialized (select doc_id, topic, {a} + sum(tf / norm * m) as g
                    from part{t}_{r} join norm{t}_{r} using (doc_id, term_id) group by all)"""
                )
        rate = f"pow({2 + t}::double, -0.5)"
        ctes += [
            f"""seen{t} as (select term_id, topic, sum(tf / norm * m) as n
                from part{t}_{rounds} join norm{t}_{rounds} using (doc_id, term_id) group by all)""",
            f"""lambda{t + 1} as materialized (select term_id, topic, (1 - {rate}) * x + {rate} * ({b} + coalesce(n, 0)) as x
                from lambda{t} left join seen{t} using (term_id, topic))""",
        ]
    return _sql(_model_ctes() + ctes, f"select term_id, topic, round(x, 6) as x from lambda{steps}")


def _left_to_right(particles: int) -> str:
    a = f"{ALPHA}::double"
    return "with recursive " + ",\n".join(
        _model_ctes() + [
            """tokens as materialized (select doc_id, term_id, row_number() over
                (partition by doc_id order by term_id, p) - 1 as n from occ)""",
            "lists as materialized (select term_id, list(prob order by topic) as p from phi group by term_id)",
            f"""walk as (
                select doc_id, r, 0::bigint as n, [{", ".join(["0.0::double"] * K)}] as counts, 0.0::double as seen
                from (select distinct doc_id from tokens), (select unnest(range({particles})) as r)
                union all
                select doc_id, r, n + 1,
                    list_transform(counts, lambda x, i: x + (case when i = z + 1 then 1 else 0 end)), seen
                from (
                    select doc_id, r, n, counts, sums[{K}] / (n + {K} * {a}) as seen,
                        least(len(list_filter(sums, lambda c: c < sums[{K}]
                            * ({_hash(f"'42:0:1:' || doc_id || ':' || (r + {particles} * n)")} / 4294967296.0::double))), {K - 1}) as z
                    from (
                        select w.doc_id, r, w.n, counts, list_transform(range(1, {K + 1}), lambda k:
                            list_sum(list_transform(range(1, k + 1), lambda j: p[j] * (counts[j] + {a})))) as sums
                        from walk w join tokens t on t.doc_id = w.doc_id and t.n = w.n join lists using (term_id))))""",
        ]
    ) + """
    select round(exp(-sum(ln(seen)) / count(*)), 6) as perplexity
    from (select doc_id, n, avg(seen) as seen from walk where n > 0 group by all)"""


def _fold_in(rounds: int) -> str:
    """Fixed-point steps from equal shares, then the perplexity."""
    a = f"{ALPHA}::double"
    ctes = [
        "sizes as (select doc_id, sum(tf) as n from dtf group by doc_id)",
        f"share0 as (select doc_id, ks.topic, {1 / K}::double as share from sizes cross join ks)",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""mix{r} as (select d.doc_id, d.term_id, any_value(d.tf) as tf, sum(s.share * p.prob) as mix
                from dtf d join share{r} s using (doc_id) join phi p using (term_id, topic)
                group by d.doc_id, d.term_id)"""
        )
        if r < rounds:
            ctes.append(
                f"""share{r + 1} as (select s.doc_id, s.topic,
                    ({a} + sum(m.tf * s.share * p.prob / m.mix)) / ({K} * {a} + any_value(z.n)) as share
                    from share{r} s join mix{r} m using (doc_id) join phi p using (term_id, topic)
                    join sizes z using (doc_id) group by s.doc_id, s.topic)"""
            )
    body = f"select round(exp(-sum(tf * ln(mix)) / sum(tf)), 6) as perplexity from mix{rounds}"
    return _sql(_model_ctes() + ctes, body)


def oracle_sql() -> dict[str, str]:
    text, vocab, dtf, model = _text_ctes(), _vocab_ctes(), _dtf_ctes(), _model_ctes()
    listing = _sql(vocab, "select term, term_id, freq from vocab")
    frequencies = _sql(dtf, "select doc_id, term_id, tf from dtf")
    phi = _sql(model, "select term_id, topic, round(prob, 9) as prob from phi")
    split = f"case when {_hash(chr(39) * 2 + ' || doc_id || ' + repr(':42:split'))} < 0.2 * 4294967296 then 'test' else 'train' end"
    topic_sums = _sql(
        _model_ctes(),
        "select topic, count(*) as n_terms, 1.0::double as total, true as better from ks cross join vocab group by topic",
    )
    sampled = f"{_hash('doc_id || ' + repr(':42'))} < 0.8 * 4294967296"
    return {
        "warc_records": """select page_id, 'response' as warc_type,
            length(html) + 44 as html_chars from pages
            union all select page_id, 'request', length(url) + 17 from pages
            union all select page_id, null, length(url) from pages""",
        "warc_records_hadoop": """select page_id, 'response' as warc_type,
            length(html) + 44 as html_chars from pages
            union all select page_id, 'request', length(url) + 17 from pages
            union all select page_id, null, length(url) from pages""",
        "response_pages": "select page_id, html from pages",
        "page_text": _page_text(),
        "tokenize": _sql(text, "select doc_id, token, count(*) as n from tok group by all"),
        "tokenize_abbrev": r"""select doc_id, token, count(*) as n from (select doc_id,
            unnest(regexp_extract_all(text, '(?:[a-zA-Z]\.){2,}|[a-zA-Z]+')) as token
            from documents) group by all""",
        "clean_tokens": _sql(text, "select doc_id, token, count(*) as n from cleaned group by all"),
        "stem_vocabulary": _sql(text, "select token, stem, n from stems"),
        "preprocess_tokens": _sql(
            text,
            """select doc_id, stem, count(*) as n from cleaned join stems using (token)
            where length(stem) between 3 and 14 group by all""",
        ),
        "term_counts": _sql(vocab, "select term, freq from counts"),
        "vocabulary": listing,
        "dictionary_listing": listing,
        "dictionary_roundtrip": _sql(vocab, "select term, term_id from vocab"),
        "doc_term_freq": frequencies,
        "doc_vectors": frequencies,
        "vectors_roundtrip": frequencies,
        "reuse_or_build": frequencies,
        "ml_vectors": frequencies,
        "nonempty_docs": _sql(
            dtf, "select doc_id, cast(count(*) as integer) as n_terms from dtf group by doc_id"
        ),
        "corpus_size": _sql(dtf, f"select count(distinct doc_id) as docs from dtf where {sampled}"),
        "token_totals": _sql(
            dtf,
            f"select {split} as split, cast(sum(tf) as bigint) as tokens from dtf group by 1",
        ),
        "subsample": f"select doc_id from documents where {sampled}",
        "train_test_split": f"select doc_id, {split} as split from documents",
        "force_repartition": frequencies,
        "doc_index": "select doc_id, row_number() over (order by doc_id) - 1 as idx from documents",
        "term_blocks": _sql(
            vocab + ["size as (select count(*) as v, cast(ceil(count(*) / 300.0) as bigint) as k from vocab)"],
            "select term_id, cast(term_id * k // v as integer) as block from vocab cross join size",
        ),
        "word_topic_counts": _sql(model, "select term_id, topic, n from nwk"),
        "topic_totals": _sql(model, "select topic, n from nk"),
        "topic_word_probs": phi,
        "model_export": phi,
        "model_import": phi,
        "doc_topics": _sql(model, "select doc_id, topic, round(prob, 9) as prob from theta"),
        "describe_topics": _sql(
            model,
            """select topic, cast(rank as integer) as rank, term, round(prob, 9) as prob
            from (select topic, term_id, prob, row_number() over
                (partition by topic order by prob desc, term_id) as rank from phi)
            join vocab using (term_id) where rank <= 50""",
        ),
        "top_k_per_group": """select o_custkey, o_orderkey, cast(rnk as integer) as rnk
            from (select o_custkey, o_orderkey, row_number() over
                (partition by o_custkey order by o_totalprice desc, o_orderkey) as rnk from orders)
            where rnk <= 3""",
        "minibatch_fraction": _sql(
            dtf,
            """select least(1.0::double, 0.02::double + 1.0::double / count(distinct doc_id))
            as fraction from dtf""",
        ),
        "heldout_perplexity": _sql(
            model + [
                """scored as (select doc_id, term_id, any_value(tf) as tf, sum(t.prob * p.prob) as mix
                from dtf join theta t using (doc_id) join phi p using (term_id, topic)
                group by doc_id, term_id)"""
            ],
            "select round(exp(-sum(tf * ln(mix)) / sum(tf)), 6) as perplexity from scored",
        ),
        "gibbs_sweep": _gibbs(),
        "lda_mh": _sql(
            dtf, "select term_id, cast(sum(tf) as bigint) as n, true as better from dtf group by term_id"
        ),
        "lda_gibbs": _gibbs_sweeps(2),
        "lda_gibbs_joined": _gibbs_sweeps(2),
        "lda_em": _sql(_em_ctes(2), "select term_id, topic, round(n, 6) as n from word2"),
        "lda_online": topic_sums,
        "model_from_ml": topic_sums,
        "checkpoint_resume": _sql(
            dtf, "select term_id, cast(sum(tf) as bigint) as n, 0::bigint as gap from dtf group by term_id"
        ),
        "train_perplexity": _sql(
            _em_ctes(2),
            """select cast(sum(tf) as bigint) as tokens, round(exp(-sum(tf * ln(mix)) / sum(tf)), 6) as perplexity
            from mix1""",
        ),
        "online_steps": _online_steps(2, 3),
        "heldout_left_to_right": _left_to_right(2),
        "heldout_fold_in": _fold_in(3),
        "heldout_fold_in_joined": _fold_in(3),
        "reuse_smaller_vocabulary": _sql(
            dtf, "select doc_id, term_id, tf from dtf where term_id < 300"
        ),
        "records_without_ids": "select html, count(*) as n from pages group by html",
    }
