"""SQL for DuckDB with the results of the core queries, on the same tables and views.

A text operator is an expression or a few CTEs over a source (doc_id, md), so each
is written once for the papers and the manuscripts."""

from __future__ import annotations

from quire.views import with_views

_WS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
S = f"[{_WS}]"
D = r"\p{Nd}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{S}+$', '')"


def _spelled(x: str) -> str:
    for old, new in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"), ("–", "-")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _few_blank(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _line_ends(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {_rstrip('l')}), chr(10))"


def _cleaned(x: str) -> str:
    return _line_ends(_few_blank(_spelled(x)))


def _abstract(x: str) -> str:
    return rf"regexp_replace({x}, '(?im)^(?:#+{S}*)?Abstract{S}*[-–—]{S}*', '## Abstract' || chr(10) || chr(10))"


def _terms(x: str) -> str:
    return rf"regexp_replace({x}, '(?im)^(?:#+{S}*)?Index Terms{S}*[-–—]{S}*', '## Index Terms' || chr(10) || chr(10))"


_P1 = rf"^({D}+(?:\.{D}+)+){S}+([A-Z][^.]+?)\.?{S}*$"
_P2 = rf"^({D}+(?:\.{D}+)+){S}+([A-Z][^.]{{2,50}})\.{S}+(.+)$"


def _level(n: str) -> str:
    return f"least(length({n}) - length(replace({n}, '.', '')) + 2, 6)"


def _head(s: str, p: str) -> str:
    n = f"regexp_extract({s}, '{p}', 1)"
    return f"repeat('#', cast({_level(n)} as int)) || ' ' || {n} || ' ' || {_strip(f'''regexp_extract({s}, '{p}', 2)''')}"


def _exploded(name: str, source: str) -> str:
    """CTE of the lines (doc_id, l, pos) of a source."""
    return f"{name} as (select doc_id, unnest(string_split(md, chr(10))) as l, generate_subscripts(string_split(md, chr(10)), 1) as pos from {source})"


def _by_line(n: str, source: str, cases: str) -> str:
    """CTE ``n`` (doc_id, md): lines of ``source`` with the next line and the next that is not blank; ``cases`` gives the text that replaces a line."""
    return f"""{_exploded(n + 'l', source)},
{n}m as (select *, {_strip('l')} as s, lead(l) over w as nx, first_value(case when {_strip('l')} <> '' then l end ignore nulls) over (partition by doc_id order by pos rows between 1 following and unbounded following) as nb
  from {n}l window w as (partition by doc_id order by pos)),
{n} as (select doc_id, string_agg({cases}, chr(10) order by pos) as md from {n}m group by doc_id)"""


_HEADINGS = f"""case when starts_with(s, '#') then l
 when regexp_matches(s, '{_P1}') and length({_strip(f"regexp_extract(s, '{_P1}', 2)")}) <= 120 then {_head('s', _P1)} || case when {_strip("coalesce(nx, '')")} <> '' then chr(10) else '' end
 when regexp_matches(s, '{_P2}') then {_head('s', _P2)} || chr(10) || chr(10) || {_strip(f"regexp_extract(s, '{_P2}', 3)")}
 else l end"""
_B1, _B2, _LI = rf"^-{S}*({D}+[).]){S}*(.+):{S}*$", rf"^-{S}*({D}+)\){S}*(.+)$", rf"^(?:[-*•]{S}|{D}+[).]{S})"
_BULLETS = f"""case when regexp_matches(l, '{_B1}') and {_strip("coalesce(nb, '')")} <> '' and not regexp_matches({_strip("coalesce(nb, '')")}, '{_LI}')
   then '### ' || regexp_extract(l, '{_B1}', 1) || ' ' || regexp_extract(l, '{_B1}', 2) || chr(10)
 when regexp_matches(l, '{_B2}') then regexp_replace(l, '{_B2}', '\\1. \\2') else l end"""


def _sections(source: str) -> str:
    """CTE sec: all section repairs over ``source``."""
    return f"s0 as (select doc_id, {_terms(_abstract('md'))} as md from {source}),\n{_by_line('hd', 's0', _HEADINGS)},\n{_by_line('sec', 'hd', _BULLETS)}"


_RANGE = rf"\[([0-9]+)\]{S}*[-–—]{S}*\[([0-9]+)\]"


def _ranges(x: str) -> str:
    num = lambda g: f"try_cast(regexp_extract_all({x}, '{_RANGE}', {g})[i] as bigint)"
    a, b = num(1), num(2)
    series = f"generate_series(least({a}, {b}), case when greatest({a}, {b}) - least({a}, {b}) <= 10000 then greatest({a}, {b}) end)"
    spelled = f"case when greatest({a}, {b}) - least({a}, {b}) <= 10000 then array_to_string(list_transform({series}, lambda n: '[' || n || ']'), ', ') end"
    parts = f"regexp_split_to_array({x}, '{_RANGE}')"
    whole = f"regexp_extract_all({x}, '{_RANGE}', 0)[i]"
    return f"(case when regexp_matches({x}, '{_RANGE}') then {parts}[1] || array_to_string(list_transform(generate_series(1, len({parts}) - 1), lambda i: coalesce({spelled}, {whole}) || {parts}[i + 1]), '') else {x} end)"


def _links(x: str) -> str:
    """Text between citations decides whether they are linked: what stands right before and after."""
    parts, nums = rf"regexp_split_to_array({x}, '\[\d{{1,3}}\]')", rf"regexp_extract_all({x}, '\[(\d{{1,3}})\]', 1)"
    before = f"(case when i > 1 then ']' else '' end || {parts}[i])"
    held = rf"(regexp_matches({before}, '(\]|\]\(|!\[)$') or starts_with({parts}[i + 1], '('))"
    one = f"case when {held} then '[' || {nums}[i] || ']' else '[[' || {nums}[i] || ']](#ref-' || {nums}[i] || ')' end"
    return rf"(case when regexp_matches({x}, '\[\d{{1,3}}\]') then {parts}[1] || array_to_string(list_transform(generate_series(1, len({parts}) - 1), lambda i: {one} || {parts}[i + 1]), '') else {x} end)"


# The headings of references by priority.
_REFERENCES = [rf"^{h}{S}*$" for h in ("## References", "## REFERENCES", "# References", "References")]


def _by_heading(x: str, found: str, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '(?m){h}') then {found.replace('{h}', h)}" for h in _REFERENCES) + f" else {otherwise} end"


def _body(x: str) -> str:
    return _by_heading(x, rf"regexp_extract({x}, '(?ms)\A(.*?){{h}}', 1)", x)


def _refs(x: str) -> str:
    return _by_heading(x, rf"regexp_extract({x}, '(?ms)\A.*?({{h}}.*)\z', 1)", "''")


def _divided(source: str) -> str:
    """(doc_id, head, md): head ends with the heading; without one md is null."""
    head = _by_heading("md", r"regexp_extract(md, '(?ms)\A(.*?{h})', 1)", "null")
    return f"select doc_id, coalesce(h, md) as head, case when h is not null then substr(md, length(h) + 1) end as md from (select doc_id, md, {head} as h from {source})"


def _anchors(x: str) -> str:
    ls = rf"string_split(regexp_replace({x}, '(?m)^-{S}*\[(\d{{1,3}})\]', '[\1]', 'g'), chr(10))"
    before = f"right(array_to_string({ls}[greatest(i - 51, 1):i - 1], chr(10)) || chr(10), 50)"
    n = r"regexp_extract({ls}[i], '^\[(\d{1,3})\]', 1)".replace("{ls}", ls)
    one = f"""case when {n} <> '' and not contains({before}, 'id="ref-' || {n} || '"') then '<a id="ref-' || {n} || '"></a>' || {ls}[i] else {ls}[i] end"""
    return f"array_to_string(list_transform(generate_series(1, len({ls})), lambda i: {one}), chr(10))"


def _cited(name: str, source: str) -> str:
    """CTE: ranges and links in the body, anchors in the references; each step is a CTE, so that no text is read twice."""
    return f"""{name}0 as (select doc_id, {_body('md')} as body, {_refs('md')} as refs from {source}),
{name}1 as (select doc_id, {_ranges('body')} as body, refs from {name}0),
{name} as (select doc_id, {_links('body')} || case when refs <> '' then {_anchors('refs')} else '' end as md from {name}1)"""


_ENTRY = rf"^{S}*(?:<a[^>]*></a>)?(?:-{S}*)?\[(\d{{1,3}})\]"


def _spaced(name: str, source: str) -> str:
    """CTE (doc_id, md): entries of ``source`` (doc_id, head, md) spaced."""
    return f"""{name}l as (select doc_id, head, unnest(string_split(md, chr(10))) as l, generate_subscripts(string_split(md, chr(10)), 1) as pos from {source} where md is not null),
{name}e as (select *, {_strip('l')} = '' as blank, regexp_matches(l, '{_ENTRY}') as entry, sum(case when {_strip('l')} = '' then 1 else 0 end) over (partition by doc_id order by pos) as run from {name}l),
{name}p as (select *, coalesce(max(case when entry then 1 else 0 end) over (partition by doc_id, run order by pos rows between unbounded preceding and 1 preceding), 0) as p from {name}e),
{name} as (select doc_id, any_value(head) || string_agg(case when entry and p = 1 then chr(10) || l else l end, chr(10) order by pos) as md from {name}p group by doc_id
 union all select doc_id, head from {source} where md is null)"""


def _mapped(images: str) -> str:
    return f"""m as (select doc_id, num, arg_max(filename, ord) as filename from
  (select *, try_cast(nullif(regexp_extract(filename, '(?i)(?:figure|fig)[_-]?([0-9]+)', 1), '') as int) as num from {images}) where num is not null group by doc_id, num)"""


_CAP = rf"(?i)(?:^|{S})(Fig(?:ure)?\.?{S}*({D}+))[.:{_WS}]"


def _embedded(name: str, source: str) -> str:
    return f"""{_exploded(name + 'l', source)},
{name}n as (select *, try_cast(nullif(regexp_extract(l, '{_CAP}', 2), '') as int) as num from {name}l),
{name}o as (select n.*, m.filename, row_number() over (partition by n.doc_id, n.num order by pos) as r from {name}n n left join m on m.doc_id = n.doc_id and m.num = n.num),
{name} as (select doc_id, string_agg(case when filename is not null and r = 1 then '![Figure ' || num || '](./img/' || filename || ')' || chr(10) || chr(10) || l else l end, chr(10) order by pos) as md from {name}o group by doc_id)"""


_PLACEHOLDERS = r"regexp_replace({x}, '(?m)^[ \t]*<!-- image -->[ \t]*\n?', '', 'g')"
_IMAGE_LINE, _CAPTION_LINE = r"^!\[Figure ([0-9]+)\]\(", r"^(?:Fig|Figure|FIG|FIGURE)\.?[ \t]*([0-9]+)[.:]"
_MENTION = r"(?i)(?:^|[^a-z0-9])Fig(?:ure)?\.?[ \t]*([0-9]+)"


def _relocated(name: str, source: str) -> str:
    return f"""{name}0 as (select doc_id, {_PLACEHOLDERS.replace('{x}', 'md')} as md from {source}),
{_exploded(name + 'l', name + '0')},
{name}t as (select *, regexp_extract(l, '{_IMAGE_LINE}', 1) as img, regexp_extract(l, '{_CAPTION_LINE}', 1) as cap, regexp_matches(l, '^#{{1,6}} ') as head from {name}l),
{name}h as (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as nexth from {name}t where head),
{name}i as (select doc_id, img as num, min(pos) as ipos from {name}t where img <> '' group by 1, 2),
{name}c as (select doc_id, cap as num, min(pos) as cpos from {name}t where cap <> '' group by 1, 2),
{name}n as (select doc_id, pos, unnest(regexp_extract_all(l, '{_MENTION}', 1)) as num from {name}t where img = '' and cap = ''),
{name}f as (select n.doc_id, n.num, min(n.pos) as told from {name}n n join (select doc_id, min(pos) as first from {name}h group by 1) a on a.doc_id = n.doc_id and n.pos >= a.first group by 1, 2),
{name}g as (select i.doc_id, i.num, ipos, cpos, (select max(h.pos) from {name}h h where h.doc_id = f.doc_id and h.pos <= f.told) as home from {name}i i join {name}f f using (doc_id, num) left join {name}c using (doc_id, num)),
{name}k as (select doc_id, home, string_agg(chr(10) || chr(10) || il.l || case when cl.l is not null then chr(10) || '*' || {_strip('cl.l')} || '*' else '' end, '' order by ipos) as put
  from {name}g g join {name}t il using (doc_id) left join {name}t cl on cl.doc_id = g.doc_id and cl.pos = g.cpos where il.pos = g.ipos group by doc_id, home),
{name}x as (select doc_id, ipos as pos from {name}g union select doc_id, cpos from {name}g where cpos is not null),
{name}r as (select t.doc_id, t.pos, t.l || coalesce(k.put || chr(10), '') as l from {name}t t left join {name}k k on k.doc_id = t.doc_id and k.home = t.pos where not exists (select 1 from {name}x x where x.doc_id = t.doc_id and x.pos = t.pos)),
{name} as (select d.doc_id, case when regexp_matches(d.md, '(?m){_IMAGE_LINE}') then {_few_blank("coalesce(string_agg(r.l, chr(10) order by r.pos), '')")} else any_value(d.md) end as md from {name}0 d left join {name}r r using (doc_id) group by d.doc_id, d.md)"""


_NO_PROSE = r"^[ \t]*(?:#|\||!\[|<|>|```|[-*•] |[0-9]+[.)] |\[[0-9]+\]|(?:Fig|Figure|Table)\.?[ \t]*[0-9])"


def _merged(name: str, source: str) -> str:
    return f"""{_exploded(name + 'l', source)},
{name}w as (select *, lag(l) over w as b1, lag(l, 2) over w as b2, sum(case when starts_with(l, '```') then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as fences from {name}l window w as (partition by doc_id order by pos)),
{name}j as (select *, coalesce(regexp_matches(l, '^[a-z]') and {_strip('b1')} = '' and regexp_matches(b2, '[^.!?: \\t][ \\t]*$') and not regexp_matches(b2, '{_NO_PROSE}') and fences % 2 = 0, false) as cont from {name}w),
{name}k as (select *, coalesce(lead(cont) over w, false) as c1, coalesce(lead(cont, 2) over w, false) as c2 from {name}j window w as (partition by doc_id order by pos)),
{name} as (select doc_id, string_agg(case when c1 then '' else case when cont then ' ' when pos = 1 then '' else chr(10) end || case when c2 then regexp_replace(l, ' +$', '') else l end end, '' order by pos) as md from {name}k group by doc_id)"""


_SHORT = r"^[ \t]*[^ \t#|!<\-*`][^ \t]*(?:[ \t]+[^ \t]+){0,2}[ \t]*$"


def _without_noise(name: str, source: str) -> str:
    kind = f"case when regexp_matches(l, '{_CAPTION_LINE}') then 'C' when regexp_matches(l, '{_SHORT}') then 'S' else 'N' end"
    return f"""{_exploded(name + 'l', source)},
{name}k as (select *, {kind} as k from {name}l),
{name}n as (select *, first_value(case when k <> 'S' then k end ignore nulls) over (partition by doc_id order by pos rows between 1 following and unbounded following) as nx from {name}k),
{name} as (select doc_id, coalesce(string_agg(l, chr(10) order by pos) filter (where not (k = 'S' and coalesce(nx, '') = 'C')), '') as md from {name}n group by doc_id)"""


_LETTERED = r"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^([A-Z])\.\s+(\S+(?:\s+\S+){0,3}?)[.:]?\s*$', '##### \1. \2')), chr(10))"
_UNEMBED = r"regexp_extract_all(regexp_replace(md, 'Fig\. ([0-9])', '![Figure \1](x)', 'g'), '!\[Figure ([0-9]+)\]', 1)"


def _text_queries(view: str) -> dict[str, str]:
    """SQL of the text queries over a view of papers."""
    images = f"images_of_{view}"

    def expr(x: str) -> str:
        return with_views(f"select doc_id, {x} as md from {view}", view)

    def ctes(body: str, out: str, *more: str) -> str:
        return with_views("", view, *more).rstrip() + f",\n{body}\n{out}"

    def whole(body: str, name: str, *more: str) -> str:
        return ctes(body, f"select doc_id, md from {name}", *more)

    lines_of = f"(select doc_id, unnest(string_split(md, chr(10))) as l, generate_subscripts(string_split(md, chr(10)), 1) as pos from {view})"
    pipeline = f"{_sections(view)},\n{_cited('cit', 'sec')},\n{_mapped(images)},\n{_embedded('emb', 'cit')},\nsrc as ({_divided('emb')}),\n{_spaced('bib', 'src')}"
    return {
        "ligatures": expr(_spelled("md")),
        "blank_lines": expr(_few_blank("md")),
        "rstrip_lines": expr(_line_ends("md")),
        "cleanup_text": expr(_cleaned("md")),
        "dehyphenate": expr(rf"regexp_replace(md, '([\p{{L}}\p{{N}}_]+)-\n{S}*([a-z][\p{{L}}\p{{N}}_]*)', '\1\2', 'g')"),
        "abstract_header": expr(_abstract("md")),
        "index_terms_header": expr(_terms("md")),
        "header_level": with_views(f"select doc_id, cast(pos - 1 as int) as pos, numbering, cast({_level('numbering')} as bigint) as level from (select doc_id, pos, regexp_extract(l, '{_P1}', 1) as numbering from {lines_of}) where numbering <> ''", view),
        "section_title": with_views(f"select doc_id, cast(pos - 1 as int) as pos, length(l) <= 120 and (length(l) - length(replace(l, '. ', ''))) / 2 <= 1 as is_title from {lines_of}", view),
        "hierarchical_sections": whole(_by_line("hd", view, _HEADINGS), "hd"),
        "numbered_bullets": whole(_by_line("bl", view, _BULLETS), "bl"),
        "process_sections": whole(_sections(view), "sec"),
        "citation_ranges": expr(_ranges("md")),
        "link_citations": expr(_links("md")),
        "reference_anchors": expr(_anchors("md")),
        "references_split": with_views(f"select doc_id, {_body('md')} as body, {_refs('md')} as refs from {view}", view),
        "process_citations": whole(_cited("cit", view), "cit"),
        "bibliography_spacing": whole(f"src as (select doc_id, '' as head, md from {view}),\n{_spaced('bib', 'src')}", "bib"),
        "process_bibliography": whole(f"src as ({_divided(view)}),\n{_spaced('bib', 'src')}", "bib"),
        "reference_count": with_views(rf"select doc_id, cast(len(regexp_extract_all(md, '(?m)^{S}*(?:<a[^>]*></a>)?\[([0-9]+)\]')) as bigint) as n from {view}", view),
        "figure_map": ctes(_mapped(images), "select doc_id, num, filename from m", images),
        "embed_figures": whole(f"{_mapped(images)},\n{_embedded('emb', view)}", "emb", images),
        "relocate_figures": whole(f"{_mapped(images)},\n{_embedded('emb', view)},\n{_relocated('rel', 'emb')}", "rel", images),
        "unembedded_figures": ctes(
            f"{_mapped(images)},\ne as (select doc_id, unnest({_UNEMBED}) as num from {view})",
            "select doc_id, cast(row_number() over (partition by doc_id order by num) - 1 as int) as pos, num, filename from m where not exists (select 1 from e where e.doc_id = m.doc_id and try_cast(e.num as int) = m.num)",
            images,
        ),
        "process_markdown": ctes(pipeline, f"select doc_id, {_cleaned('md')} as md from bib", images),
        "lettered_headings": expr(_LETTERED.replace("{x}", "md")),
        "merge_paragraphs": whole(_merged("mer", view), "mer"),
        "drop_placeholders": expr(_PLACEHOLDERS.replace("{x}", "md")),
        "drop_caption_noise": whole(_without_noise("noi", view), "noi"),
    }


_KEPT = "width >= 200 and height >= 150 and width * height >= 40000"
_CLASS = "coalesce(later_class, class_name)"
_FIGURES = f"""select p.doc_id, cast(p.idx + 1 as int) as figure_id,
 coalesce(case when caption_cref like '#/tables/%' then '| ' || t.text else t.text end, '') as caption,
 case when {_CLASS} is null then null when class_name is not null and confidence > 0 then {_CLASS} || ' (' || printf('%.2f', confidence) || ')' else {_CLASS} end as classification,
 description, p.page_no as page, './img/figure' || (p.idx + 1) || '.png' as image_path,
 case when {_KEPT} then './img/figure' || sum(case when {_KEPT} then 1 else 0 end) over (partition by p.doc_id order by p.idx) || '.png' end as image_path_filtered
 from pictures p left join texts t on t.doc_id = p.doc_id and t.idx = cast(string_split(caption_cref, '/')[3] as int)"""
_META = """select doc_id, '/in/paper-' || doc_id || '.pdf' as source, case when doc_id % 2 = 0 then 'Title ' || doc_id else 'paper-' || doc_id end as title, cast(doc_id % 30 as int) as num_pages,
 cast(count(*) filter (code_language <> '') as int) as num_code_blocks, cast(count(*) as int) as num_equations, 4 as num_figures from texts group by doc_id"""
_JSON = f"""f as ({_FIGURES}),
meta as ({_META}),
code as (select doc_id, list({{'text': text, 'language': code_language, 'page': page_no, 'context': ''}} order by idx) as v from texts where code_language <> '' group by doc_id),
eq as (select doc_id, list({{'latex': text, 'text': text, 'page': page_no, 'context': ''}} order by idx) as v from texts group by doc_id),
fig as (select doc_id, list({{'figure_id': figure_id, 'caption': caption, 'classification': classification, 'description': description, 'page': page, 'image_path': image_path, 'image_path_filtered': image_path_filtered}} order by figure_id) as v from f group by doc_id)
select m.doc_id, cast(to_json({{'metadata': {{'source': source, 'title': title, 'num_pages': num_pages, 'num_code_blocks': num_code_blocks, 'num_equations': num_equations, 'num_figures': num_figures}},
 'code_blocks': coalesce(code.v, []), 'equations': eq.v, 'figures': fig.v}}) as varchar) as json from meta m left join code using (doc_id) join eq using (doc_id) join fig using (doc_id)"""
_PUB = "(select distinct on (pub_id) * from publication)"
_BIB, _TXT, _PDF = "nullif(element_at(links, 'bibtex')[1], '')", "nullif(element_at(links, 'citation')[1], '')", "nullif(element_at(links, 'pdf')[1], '')"
_MINE = f"(select * from {_PUB} where len(list_filter(authors, lambda a: contains(lower(a), 'kat'))) > 0 and lower(coalesce(type, '')) <> 'poster')"
_BLOCK = f"""'## ' || coalesce(title, 'Untitled') || chr(10) || chr(10) || '- **Year:** ' || coalesce(cast(year as varchar), 'N/A') || chr(10) || '- **Venue:** ' || coalesce(venue, 'N/A') || chr(10)
 || '- **Slug:** ' || coalesce(slug, 'unknown') || chr(10) || '- **PDF:** ' || coalesce({_PDF}, 'N/A') || chr(10) || '- **Citation:** ' || coalesce({_BIB}, {_TXT}, 'N/A') || chr(10) || chr(10) || '---' || chr(10) || chr(10)"""
_WANTED = f"""(select pub_id, 'pdf' as kind, {_PDF} as url, 'pdfs/' || coalesce(slug, 'unknown') || '.pdf' as name, 'PDF' as shown, title from {_PUB}
 union all select pub_id, 'citation', coalesce({_BIB}, {_TXT}), 'citations/' || coalesce(slug, 'unknown') || case when {_BIB} is not null then '.bib' else '.txt' end, 'citation', title from {_PUB})"""
_RESULTS = "(select coalesce(name, '') as name, coalesce(success, false) as success, coalesce(duration, 0.0) as duration from (select distinct * from batch_result))"
_LOG = f"""with r as {_RESULTS}, t as (select count(*) as n, count_if(success) as good, count_if(not success) as bad, coalesce(sum(duration), 0) as secs from r),
h as (select 0 as part, unnest(['{"=" * 60}', 'BATCH CONVERSION SUMMARY', '{"=" * 60}', '', 'Input:      /in', 'Output:     /out', 'Total PDFs: ' || n, 'Successful: ' || good, 'Failed:     ' || bad,
 'Duration:   ' || printf('%.1f', secs / 60) || ' minutes (' || printf('%.1f', secs) || 's)', 'Average:    ' || printf('%.1f', coalesce(secs / nullif(n, 0), 0)) || 's per PDF', '',
 'Options:', '  - Keep raw:      True', '  - Enrich:        True', '  - VLM describe:  True', '  - Agent cleanup: False', '', '{"-" * 60}', 'RESULTS BY PDF', '{"-" * 60}', '']) as line from t)
select part, line from h
union all select 1, '[' || case when success then 'OK    ' else 'FAILED' end || '] ' || lpad(printf('%.1f', duration), cast(greatest(7, length(printf('%.1f', duration))) as int), ' ') || 's  ' || name from r
union all select 2, unnest(['', '{"-" * 60}', 'FAILED PDFs (review individual logs)', '{"-" * 60}', '']) from t where bad > 0
union all select 3, unnest(['  - ' || name, '    Log: logs/' || regexp_extract(name, '([^/]+?)(\\.[^./]*)?$', 1) || '.log']) from r where not success"""


def oracle() -> dict[str, str]:
    """SQL of every core query by name."""
    own = {
        "image_filter": with_views(f"select doc_id, row_number() over (partition by doc_id order by idx) as num, 'figure' || row_number() over (partition by doc_id order by idx) || '.png' as filename from pictures where {_KEPT}", "pictures"),
        "code_blocks": with_views("select doc_id, text, code_language as language, page_no as page, '' as context from texts where code_language <> ''", "texts"),
        "equations": with_views("select doc_id, text as latex, text, page_no as page from texts", "texts"),
        "figure_info": with_views(_FIGURES, "pictures", "texts"),
        "doc_metadata": with_views(_META, "texts"),
        "enrichment_json": with_views("", "pictures", "texts").rstrip() + ",\n" + _JSON,
        "conversion_status": """select paper_id, status in ('SUCCESS', 'PARTIAL_SUCCESS') as ok,
            case when not status in ('SUCCESS', 'PARTIAL_SUCCESS') then coalesce(nullif(array_to_string(errors, '; '), ''), 'Unknown error') end as message,
            regexp_extract(source, '([^/]+?)(\\.[^./]*)?$', 1) as stem from (select distinct on (paper_id) * from paper_raw)""",
        "batch_summary": """select count(*) as total, count_if(success) as successful, count(*) - count_if(success) as failed, round(sum(duration), 4) as seconds, round(sum(duration) / 60, 4) as minutes,
            round(sum(duration) / nullif(count(*), 0), 4) as avg_seconds from (select distinct * from batch_result)""",
        "batch_page": "select name from (select distinct name from batch_result) order by name nulls first limit 7 offset 5",
        "summary_log": _LOG,
        "publications": f"select pub_id, title, year from {_MINE}",
        "publication_summary": f"select pub_id, {_BLOCK} as block from {_PUB}",
        "publications_file": f"""select 0 as part, 0 as year, '' as title, '# Publications' || chr(10) || chr(10) || 'Total papers: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) as block from {_MINE}
            union all select 1, coalesce(year, 0), coalesce(title, ''), {_BLOCK} from {_MINE}""",
        "download_plan": f"""select pub_id, kind, url, case when url is not null then name end as file,
            case when url is not null then 'Downloading ' || shown || ': ' || left(coalesce(title, 'Untitled'), 50) || '...' else '  No ' || shown || ' link for: ' || left(coalesce(title, 'Untitled'), 50) end as label from {_WANTED}""",
        "download_stats": f"select kind, count_if(url is not null) as success, count_if(url is null) as failed from {_WANTED} group by kind",
        "line_counts": "select doc_id, cast(length(text) - length(replace(text, chr(10), '')) as bigint) as n from documents",
    }
    return own | _text_queries("papers") | {f"md_{n}": sql for n, sql in _text_queries("manuscripts").items()}
