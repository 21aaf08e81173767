"""The registered queries as SQL over the same tables, written independently of the library's expressions, but for the fixed list of lockfile endings."""

from __future__ import annotations

from folioloom.functions.lockfiles import LOCKFILE_SUFFIXES
from folioloom.plans.corpora import CODE, COPIED_PATH, FLAT_PATH, INNER_PATH, ODD_ONE, ODD_TWO, PAGE_HINT, PAGE_URL, PATH

W = r"\t\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NL = "chr(10)"


def corpus(path: str = PATH, text: str = "text") -> str:
    return f"""corpus as (select doc_id, lang, source, relative_path, name, t, strlen(t) as size from (
      select *, list_extract(string_split(relative_path, '/'), -1) as name from (
        select doc_id, lang, source, {path} as relative_path, {text} as t from documents)))"""


NOT_VCS = "not list_contains(string_split(relative_path, '/'), '.git')"


def listed(where: str, path: str = PATH) -> str:
    return f"with {corpus(path)} select relative_path, size from corpus where {where}"


def ext(name: str = "name") -> str:
    return f"(case when regexp_matches({name}, '^.+[.][^.]*$') then regexp_extract({name}, '^.+[.]([^.]*)$', 1) end)"


def lockfile(names) -> str:
    return "(" + " or ".join(f"ends_with(lower(relative_path), '{n}')" for n in names) + ")"


LOCKED = lockfile(LOCKFILE_SUFFIXES)


# ---------------------------------------------------------------- content

def line_count(t: str) -> str:
    return f"(case when {t} = '' then 0 else len(string_split({t}, {NL})) - (case when right({t}, 1) = {NL} then 1 else 0 end) end)"


def word_count(t: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({t}, '[\n{W}]+'), lambda x: x <> ''))"


def no_comments(t: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace({t},
      '("(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z))|//[^\n]*|/\*.*?(?:\*/|\z)', '\1', 'gs'),
      '[{W}]+(\n|\z)', '\1', 'g'), '\A[\r\n]+|[\r\n]+\z', '', 'g')"""


def no_empty_lines(t: str) -> str:
    return rf"""array_to_string(list_filter(string_split(replace({t}, chr(13) || {NL}, {NL}), {NL}),
      lambda x: not regexp_full_match(x, '[{W}]*')), {NL})"""


def split_lines(t: str) -> str:
    unified = f"replace({t}, chr(13) || {NL}, {NL})"
    return f"string_split(case when right({unified}, 1) = {NL} then left({unified}, length({unified}) - 1) else {unified} end, {NL})"


def ended(t: str) -> str:
    return f"(replace({t}, chr(13) || {NL}, {NL}) || case when {t} = '' or right({t}, 1) = {NL} then '' else {NL} end)"


def numbered(t: str) -> str:
    return f"""(case when {t} = '' then '' else array_to_string(list_transform({split_lines(t)}, lambda x, i:
      lpad(i::varchar, greatest(5, length({line_count(t)}::varchar))::int, ' ') || ' | ' || x || {NL}), '') end)"""


def block(t: str, path: str = "relative_path", ticks: int = 3, body=ended) -> str:
    return f"""('## File: ' || {path} || {NL} || repeat('`', {ticks}) || coalesce({ext()}, '') || {NL}
      || case when {t} is null then '// Content not available' || {NL} else {body(t)} end || repeat('`', {ticks}) || {NL})"""


CODE_CORPUS = corpus(text=CODE)

# Bytes that continue a character at position 1025 show that the 1024-byte head cuts one.
HEAD_CUT = "substr(hex(encode(t)), 2049, 1) in ('8', '9', 'A', 'B')"
MIXED_TEXT = """(case doc_id % 10 when 0 then false when 1 then false when 2 then false when 3 then true
  when 4 then size >= 1024 else true end)"""
MIXED_HEAD = f"""(case doc_id % 10 when 0 then false when 1 then size >= 1024 and not {HEAD_CUT} when 2 then false when 3 then true
  when 4 then size >= 1024 and not {HEAD_CUT} else not {HEAD_CUT} end)"""
MIXED_SIZE = "(size + case doc_id % 10 when 0 then 1 when 1 then 1 when 2 then 5 when 3 then 4 when 4 then 1 else 0 end)"
MIXED_DECODED = "(case doc_id % 10 when 3 then chr(65279) || t || chr(65533) when 4 then t || 'x' else t end)"
MIXED_BLOB = r"""(case doc_id % 10 when 0 then '\x00'::blob || encode(t) when 1 then encode(t) || '\xFF'::blob
  when 2 then encode('%PDF-' || t) when 3 then '\xEF\xBB\xBF'::blob || encode(t) || '\xFF'::blob
  when 4 then encode(t) || '\x00'::blob else encode(t) end)"""

# ---------------------------------------------------------------- ignore rules

# kind (2 .gitignore, 3 .ignore, 4 override), base, seq, regex, negated, dir_only
RULE_ROWS = [
    (2, "", 0, r"(.*/)?[^/]*\.log", False, False), (2, "", 1, r"(.*/)?doc_1[^/]*\.log", True, False),
    (2, "", 2, r"(.*/)?target", False, True), (2, "", 3, r"en/src1/doc_[^/]*\.md", False, False),
    (2, "", 4, r"(.*/)?build/out", False, False), (2, "", 5, r"pkg[^/]*/Makefile", False, False),
    (2, "", 8, r"(.*/)?!odd", False, False),
    (2, "en", 0, r"(.*/)?[^/]*\.txt", False, False), (2, "en", 1, r"(.*/)?doc_2[^/]*\.txt", True, False),
    (2, "en", 2, r"src2/.+", False, False), (3, "fr", 0, r"(.*/)?[^/]*\.log", True, False),
]
OVERRIDE_ROWS = [(4, "", 0, r"(.*/)?doc_3[^/]*\.log", True, False), (4, "", 1, r"(.*/)?src5/pkg[^/]*", True, False),
                 (4, "", 2, r"(.*/)?target", True, False)]
LAST_ROWS = [(4, "", 0, r"(.*/)?[^/]*\.md", True, False), (4, "", 1, r"(.*/)?en/src1/[^/]*", True, False),
             (4, "", 3, r"(.*/)?[^/]*/pkg[^/]7/\.env", True, False), (4, "", 4, r"(.*/)?build/.+", True, False)]


def values(rows) -> str:
    def lit(v):
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"

    return "values " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def ignoring(rules: str) -> str:
    """CTEs ending in `bad(scope, path)`; `rules(scope, kind, base, seq, re, negated, dir_only)`, `files(scope, path)`."""
    return f"""rules as ({rules}),
    nodes as (select scope, path, sg, unnest(range(1, len(sg) + 1)) as n from (
      select scope, path, string_split(path, '/') as sg from files)),
    above as (select scope, path, n, n < len(sg) as is_dir, sg, unnest(range(0, n)) as i from nodes),
    asked as (select scope, path, n, is_dir, array_to_string(sg[1:i], '/') as base, array_to_string(sg[i + 1:n], '/') as rel from above),
    matched as (select a.scope, a.path, a.n, r.negated, row_number() over (
        partition by a.scope, a.path, a.n order by r.kind desc, length(r.base) desc, r.seq desc) as rn
      from asked a join rules r on r.scope = a.scope and r.base = a.base and (a.is_dir or not r.dir_only)
        and regexp_full_match(a.rel, r.re, 's')),
    bad as (select distinct scope, path from matched where rn = 1 and not negated)"""


def rule_values(rows) -> str:
    return f"select '' as scope, * from ({values(rows)}) v(kind, base, seq, re, negated, dir_only)"


FILES = "files as (select '' as scope, relative_path as path from corpus)"
KEPT = "relative_path not in (select path from bad)"


def ignored_check(rows) -> str:
    return f"with {corpus()}, {FILES}, {ignoring(rule_values(rows))} select relative_path, size from corpus where {KEPT}"


RULE_TABLE = r"""select lang as scope, 2 as kind, source as base, p.seq, p.re, p.negated, p.dir_only
  from (select distinct lang, source from documents) d, lateral (values
    (0, '(.*/)?[^/]*\.log', false, false), (1, '(.*/)?doc_' || substr(d.source, 4, 1) || '[^/]*\.log', true, false),
    (2, '(.*/)?target', false, true), (3, 'build', false, false), (4, '(.*/)?doc_[^/]*7\.[^/]*', false, false),
    (5, '(.*/)?\.env', false, false), (6, '(.*/)?\.env\.local', true, false), (7, '(.*/)?[^/]*\.rs', false, false),
    (8, '(.*/)?doc_7[^/]*', true, false)) p(seq, re, negated, dir_only)"""

# ---------------------------------------------------------------- order

LAST_INDEX = r"""(case when regexp_full_match(relative_path, '.*\.md', 's') then 0
  when starts_with(relative_path, 'en/src1/') then 1 when regexp_full_match(relative_path, '.*/pkg.7/\.env', 's') then 3
  when regexp_full_match(relative_path, '(.*/)?build/.*', 's') then 4 end)"""
IN_ORDER = f"{LAST_INDEX} is not null, {LAST_INDEX} nulls first, string_split(relative_path, '/')"
BY_PATH = "string_split(relative_path, '/')"

COUNTED_ITEM = f"""('- ' || relative_path || ' (L:' || {line_count('t')} || ' C:' || size || ' W:' || {word_count('t')} || ')' || {NL})"""


def document(rows: str, text: str = "t", group: str = "", item: str | None = None, sort: str = IN_ORDER) -> str:
    """`pieces(group, position, text)` of the `rows` CTE."""
    by = f"partition by {group} " if group else ""
    cols = f"{group}, " if group else ""
    gap = f"case when p > 1 then {NL} else '' end"
    ranked = f"ranked as (select *, row_number() over ({by}order by {sort}) as p, count(*) over ({by}) as n from {rows})"
    blocks = f"select {cols}p as position, {gap} || {block(text)} as text from ranked"
    if item is None:
        return f"{ranked}, pieces as ({blocks})"
    head = f"select {cols}n + 1 as position, {NL} || '---' || {NL} || 'Processed Files: (' || n || ')' || {NL} as text from ranked where p = 1"
    return f"{ranked}, pieces as ({blocks} union all {head} union all select {cols}n + 1 + p, {item} from ranked)"


def document_lines(group: str = "") -> str:
    """Numbered lines of the pieces; every piece ends with a newline."""
    cols, by = (f"{group}, ", f"partition by {group} ") if group else ("", "")
    return (f", cut as (select {cols}position, string_split(left(text, length(text) - 1), {NL}) as ls from pieces), "
            f"each as (select {cols}position, generate_subscripts(ls, 1) as i, unnest(ls) as value from cut) "
            f"select {cols}row_number() over ({by}order by position, i) as line, value from each")


MARKDOWN = f"md as (select * from corpus where {NOT_VCS})"
TALK = """talk as (select conv_id, relative_path, relative_path as name, text as t, strlen(text) as size from (
  select *, lpad(turn::varchar, 19, '0') || '_' || role || '.txt' as relative_path from conversations))"""

STREAMED = f"""with {CODE_CORPUS}, {FILES}, {ignoring(rule_values(RULE_ROWS + LAST_ROWS))},
  done as (select *, {no_empty_lines(no_comments('t'))} as clean from corpus
    where {NOT_VCS}"""

# ---------------------------------------------------------------- repositories

REFS = """refs as (select 'repo_' || source as repo, v.* from (select distinct source from documents) d, lateral (values
    ('head', case when d.source = 'src3' then null else 'main' end, null::varchar),
    ('branch', case when d.source = 'src4' then 'trunk' else 'main' end, 'c' || substr(d.source, 4) || '_main'),
    ('branch', 'release', 'c' || substr(d.source, 4) || '_release'), ('tag', 'release', 'c' || substr(d.source, 4) || '_tagged'),
    ('tag', 'v1', 'c' || substr(d.source, 4) || '_v1')) v(kind, name, commit)),
  asked as (select doc_id, 'repo_' || source as repo,
    case doc_id % 5 when 0 then 'release' when 1 then 'v1' when 2 then 'nope' when 3 then 'main' else null end as name from documents),
  resolved as (select a.*, coalesce(b.commit, case when a.name is not null then t.commit else h.commit end) as commit,
      case when a.name is not null then case when b.commit is not null then 'branch' when t.commit is not null then 'tag' else 'ref_not_found' end
        when coalesce(b.commit, h.commit) is not null then 'default' else 'no_default' end as resolved_as
    from asked a left join refs h on h.repo = a.repo and h.kind = 'head'
      left join refs b on b.repo = a.repo and b.kind = 'branch' and b.name = coalesce(a.name, h.name)
      left join refs t on t.repo = a.repo and t.kind = 'tag' and t.name = a.name)"""

SNAPSHOTS = """old as (select relative_path, t as content from corpus where doc_id % 7 <> 0),
  new as (select relative_path, t || case when doc_id % 13 = 0 then 'edit' else '' end as content from corpus where doc_id % 9 <> 0)"""

IS_GIT = "(starts_with(url, 'https://') or starts_with(url, 'http://') or starts_with(url, 'git@') or starts_with(url, 'file://'))"


# Fixed values, written down again so that a slip in the library's list shows.
RESERVED = ("releases tags pull issues actions projects wiki security pulse graphs settings blob tree commit blame find").split()


def owner_of(url: str) -> str:
    """Last piece but one, if only the host and one `/` or `:` stand before it."""
    lead = f"array_to_string(string_split({url}, '/')[:-2], '/')"
    after = f"array_to_string(string_split({lead}, 'github.com')[2:], 'github.com')"
    return f"case when {after}[1] in ('/', ':') and {after}[2:] not like '%/%' then nullif({after}[2:], '') end"


def repo_of(url: str) -> str:
    name = f"string_split({url}, '/')[-1]"
    return f"case when {owner_of(url)} is not null then nullif(case when {name} like '_%.git' then {name}[:-5] else {name} end, '') end"


def urls(hint: str) -> str:
    reserved = ", ".join(f"'{s}'" for s in RESERVED)
    return rf"""u as (select page_id, {PAGE_URL} as url, {hint} as hint from pages),
  seg as (select *, string_split(url, '/') as s from u),
  cut as (select *, case when s[1] = 'https:' and s[2] = '' and s[3] = 'github.com' and s[4] <> '' and s[5] <> '' and s[6] in ('tree', 'blob')
      and len(s) > 6 and array_to_string(s[7:], '/') <> '' then s[4] end as o, s[5] as r,
    rtrim(array_to_string(s[7:], '/'), '/') as rest, {owner_of('url')} as co, {repo_of('url')} as cr,
    list_filter(string_split(substr(url, 20), '/'), lambda x: x <> '') as parts from seg),
  sorted as (select *, case when o is not null then 1
      when starts_with(url, 'https://github.com/') and len(parts) >= 3 and parts[3] not in ({reserved}) then 2
      when co is not null and cr is not null then 3 else 4 end as way,
    case when coalesce(rest = hint or starts_with(rest, hint || '/'), false) then hint else split_part(rest, '/', 1) end as br from cut),
  parsed as (select page_id, url, way,
    case way when 1 then 'https://github.com/' || o || '/' || r || '.git'
      when 2 then 'https://github.com/' || parts[1] || '/' || regexp_replace(parts[2], '(\.git)+$', '') || '.git'
      when 3 then 'https://github.com/' || co || '/' || cr || '.git' end as clone_url,
    case way when 1 then br when 4 then null else 'HEAD' end as branch,
    case way when 1 then substr(rest, length(br) + 2) when 2 then array_to_string(parts[3:], '/') when 3 then '' end as subdirectory
    from sorted)"""


# ---------------------------------------------------------------- checks

CHECKS = {
    "ext_filter": listed(f"coalesce(lower({ext()}) in ('rs', 'txt', 'gz', 'lock'), false) and coalesce(lower({ext()}), '') <> 'lock'"),
    "size_filter": listed(f"size <= 2000 and {NOT_VCS}"),
    "size_literal": listed(f"size <= 1536 and {NOT_VCS}"),
    "given_sizes": f"with {corpus()} select relative_path, doc_id * 3 as size from corpus where doc_id * 3 <= 2000 and {NOT_VCS}",
    "path_regex": listed(rf"(regexp_matches(relative_path, '^EN/src1\d?/', 'i') or regexp_matches(relative_path, 'makefile$', 'i')) and {NOT_VCS}"),
    "path_exclude_regex": listed(rf"not regexp_matches(relative_path, '^de/|/logs/|\.md$', 'i') and {NOT_VCS}"),
    "filename_regex": listed(rf"regexp_matches(name, '^doc_\d*7\.|^\.env', 'i') and {NOT_VCS}"),
    "lockfile_skip": listed(f"not {LOCKED} and {NOT_VCS}"),
    "lockfiles_any_case": listed(lockfile([s.lower() for s in LOCKFILE_SUFFIXES])),
    "combined_filters": listed(
        f"coalesce(lower({ext()}) in ('rs', 'md', 'txt'), false) and size <= 4096 and relative_path like '%src1%' "
        f"and relative_path not like 'fr/%' and relative_path not like '%/logs/%' and not {LOCKED} and {NOT_VCS}"),
    "ignore_globs": listed(
        "not ends_with(relative_path, '.log') and relative_path not like '%/target/%' "
        "and not regexp_matches(relative_path, '(^|/)pkg1.(/|$)') and not regexp_matches(relative_path, '(^|/)src3/doc_[^1-5]') "
        f"and {NOT_VCS}"),
    "vcs_dir_skip": listed("relative_path not like '%/.git/%'"),
    "vcs_dir_wanted": listed("relative_path like '%/.git/%'"),
    "non_recursive": listed("relative_path not like '%/%'", FLAT_PATH),
    "ignore_rules": ignored_check(RULE_ROWS),
    "ignore_rules_off": listed("true"),
    "ignore_rules_override": ignored_check(RULE_ROWS + OVERRIDE_ROWS),
    "ignore_rule_table": f"""with {corpus(INNER_PATH)}, files as (select lang as scope, relative_path as path from corpus),
      {ignoring(RULE_TABLE)} select lang, relative_path, size from corpus
      where (lang, relative_path) not in (select (scope, path) from bad)""",
    "rules_in_corpus": f"""select kind, base, seq, pattern from (
      select case when doc_id % 2 = 0 then 'gitignore' else 'ignore' end as kind, concat_ws('/', lang, source, 'p' || doc_id) as base,
        unnest(range(len(l))) as seq, unnest(l) as pattern
      from (select *, string_split(text, {NL}) as l from documents)) where trim(pattern) <> ''""",
    "process_last": f"""with {corpus()} select relative_path, {LAST_INDEX} is not null as is_process_last,
      {LAST_INDEX}::bigint as process_last_order from corpus""",
    "process_last_many": f"""with {corpus()}, numbers as (select relative_path,
        3 * try_cast(regexp_extract(relative_path, '(?:^|/)pkg([0-9]+)/[.]env$', 1) as bigint) as env,
        3 * try_cast(regexp_extract(relative_path, '(?:^|/)doc_([0-9]+)[.]md$', 1) as bigint) + 1 as doc,
        3 * try_cast(regexp_extract(relative_path, '^en/src([0-9]+)/.*[.]rs$', 1) as bigint) + 2 as src from corpus),
      firsts as (select relative_path, least(case when env < 1500 then env end, case when doc < 1500 then doc end, case when src < 1500 then src end) as found from numbers)
      select relative_path, found is not null as is_process_last, found as process_last_order from firsts""",
    "only_last": f"with {corpus()} select relative_path, {LAST_INDEX}::bigint as process_last_order from corpus where {LAST_INDEX} is not null",
    "document_order": f"with {corpus()} select relative_path, row_number() over (order by {IN_ORDER}) as position from corpus",
    "order_per_language": f"""with {corpus()} select lang, relative_path,
      row_number() over (partition by lang order by {BY_PATH}) as position from corpus""",
    "binary_filter": f"with {corpus()} select doc_id, {MIXED_SIZE} as size from corpus where {MIXED_TEXT}",
    "text_head": f"with {corpus()} select doc_id, {MIXED_HEAD} as listed, {MIXED_TEXT} as processed from corpus",
    "binary_counts": f"""with {corpus()}, d as (select *, {MIXED_DECODED} as x, {MIXED_TEXT} as ok from corpus)
      select doc_id, not ok as is_binary, case when ok then {line_count('x')} else 0 end as lines,
        case when ok then strlen(x) else {MIXED_SIZE} end as characters,
        case when ok then {word_count('x')} else 0 end as words from d""",
    "lossy_decode": f"""with {corpus()}, d as (select doc_id, case doc_id % 10 when 0 then chr(0) || t when 1 then t || chr(65533)
        when 2 then '%PDF-' || t when 3 then chr(65279) || t || chr(65533) when 4 then t || chr(0) else t end as x from corpus)
      select doc_id, strlen(x) as bytes, md5(x) as digest from d""",
    "dry_run": f"""with {corpus()}, l as (select relative_path, row_number() over (order by {IN_ORDER}) as p from corpus where {MIXED_HEAD})
      select 1::bigint as position, {NL} || '--- Dry Run: Files that would be processed ---' || {NL} as text
      union all select p + 1, '- `' || relative_path || '`' || {NL} from l
      union all select (select count(*) from l) + 2, '--- End Dry Run ---' || {NL}""",
    "dry_run_exact": f"""with {corpus()}, l as (select relative_path, row_number() over (order by {IN_ORDER}) as p from corpus
        where {MIXED_TEXT} and {NOT_VCS} and coalesce(lower({ext()}) in ('md', 'txt', 'rs'), false))
      select 1::bigint as position, {NL} || '--- Dry Run: Files that would be processed ---' || {NL} as text
      union all select p + 1, '- ' || relative_path || {NL} from l
      union all select (select count(*) from l) + 2, '--- End Dry Run ---' || {NL}""",
    "file_counts": f"""with {CODE_CORPUS} select doc_id, {line_count('t')} as lines, strlen(t) as characters, {word_count('t')} as words from corpus""",
    "page_counts": f"select page_id, {line_count('html')} as lines, strlen(html) as characters, {word_count('html')} as words from pages",
    "remove_comments": f"with {CODE_CORPUS} select doc_id, {no_comments('t')} as processed_content from corpus",
    "remove_empty_lines": f"with {CODE_CORPUS} select doc_id, {no_empty_lines('t')} as processed_content from corpus",
    "filter_chain": f"""with {CODE_CORPUS} select doc_id, {no_empty_lines(no_comments("replace(t, 'note', '// own')"))} as processed_content,
      {word_count('t')} as words from corpus""",
    "python_content_filter": f"with {CODE_CORPUS} select doc_id, {no_comments("replace(t, 'note', 'NOTE')")} as processed_content from corpus",
    "processed_rows": f"""with {CODE_CORPUS}, {FILES}, {ignoring(rule_values(RULE_ROWS + LAST_ROWS))}
      select relative_path, relative_path as absolute_path, size, {no_empty_lines(no_comments('t'))} as processed_content,
        {line_count('t')} as lines, strlen(t) as characters, {word_count('t')} as words,
        {LAST_INDEX} is not null as is_process_last, {LAST_INDEX}::bigint as process_last_order, false as is_binary
      from corpus where {NOT_VCS} and not {LOCKED} and {KEPT}""",
    "path_parts": f"""with {corpus()} select relative_path, name, {ext()} as extension,
      left(relative_path, length(relative_path) - length(name) - 1) as folder, len(string_split(relative_path, '/')) as depth,
      '`' || relative_path || '/x`' as shown from corpus""",
    "text_lines": f"""with {CODE_CORPUS} select doc_id, unnest(range(len(l))) as at, unnest(l) as line
      from (select doc_id, {split_lines('t')} as l from corpus)""",
    "line_numbers": f"with {CODE_CORPUS} select doc_id, {numbered('t')} as numbered from corpus",
    "file_blocks": f"""with {CODE_CORPUS}, d as (select *, case when doc_id % 19 <> 0 then t end as c from corpus)
      select doc_id, {block('c')} as block from d""",
    "blocks_filename_only": f"""with {CODE_CORPUS}, d as (select *, case when doc_id % 19 <> 0 then t end as c from corpus)
      select doc_id, {block('c', "'`' || name || '`'", 5, numbered)} as block from d""",
    "summary_lines": f"""with {CODE_CORPUS} select doc_id, '- ' || relative_path || case when doc_id % 23 = 0 then ' (Counts not available)'
      when doc_id % 10 = 0 then ' (Binary C:' || strlen(t) || ')'
      else ' (L:' || {line_count('t')} || ' C:' || strlen(t) || ' W:' || {word_count('t')} || ')' end as summary_line from corpus""",
    "ordered_document": f"with {corpus()}, {MARKDOWN}, {document('md', item=COUNTED_ITEM)} select position, text from pieces",
    "plain_document": f"""with {corpus()}, {MARKDOWN},
      {document('md', sort=BY_PATH)} select position, text from pieces""",
    "repository_documents": f"""with {corpus(INNER_PATH)}, files as (select lang as scope, relative_path as path from corpus),
      {ignoring(RULE_TABLE)}, md as (select * from corpus where {NOT_VCS} and (lang, relative_path) not in (select (scope, path) from bad)),
      {document('md', group='lang', sort=BY_PATH)} select lang, position, text from pieces""",
    "odd_groups": f"""with {corpus()}, md as (select *, {ODD_ONE} as one, {ODD_TWO} as two from corpus),
      {document('md', group='one, two', item=COUNTED_ITEM, sort=BY_PATH)}
      select one, two, 0::bigint as chunk, string_agg(text, '' order by position) as text from pieces group by one, two""",
    "tied_copies": f"""select doc_id, row_number() over (order by string_split({COPIED_PATH}, '/'), {ODD_ONE} is not null, {ODD_ONE}, doc_id) as position
      from documents""",
    "digest_per_group": f"""with {TALK}, {document('talk', group='conv_id', sort=BY_PATH)}
      select conv_id, 0::bigint as chunk, string_agg(text, '' order by position) as text from pieces group by conv_id""",
    "digest_per_group_summary": f"""with {TALK}, {document('talk', group='conv_id', item=COUNTED_ITEM, sort=BY_PATH)}
      select conv_id, 0::bigint as chunk, string_agg(text, '' order by position) as text from pieces group by conv_id""",
    "group_document_rows": f"with {TALK}, {document('talk', group='conv_id', sort=BY_PATH)} select conv_id, position, text from pieces",
    "written_document": f"with {corpus()}, {MARKDOWN}, {document('md', item=COUNTED_ITEM, sort=BY_PATH)} {document_lines()}",
    "kept_document": f"with {corpus()}, {MARKDOWN}, {document('md', item=COUNTED_ITEM, sort=BY_PATH)} {document_lines()}",
    "printed_document": f"with {corpus()}, {MARKDOWN}, {document('md', sort=BY_PATH)} select position, text from pieces",
    "written_group_documents": f"with {TALK}, {document('talk', group='conv_id', sort=BY_PATH)} {document_lines('conv_id')}",
    "json_format": f"""with {corpus()} select row_number() over (order by {BY_PATH}) as line,
      '{{"path":"' || relative_path || '","size":' || size || '}}' as value from corpus""",
    "ref_resolution": f"with {REFS} select doc_id, repo, name, commit, resolved_as from resolved",
    "checked_out": f"""with {REFS}, {corpus()}, versions as (select 'repo_' || source as repo, 'c' || substr(source, 4) || case doc_id % 4
        when 0 then '_main' when 1 then '_release' when 2 then '_tagged' else '_v1' end as commit, relative_path, t as content from corpus)
      select * from versions where (repo, commit) in (select (repo, commit) from resolved where commit is not null)""",
    "snapshot_diff": f"""with {corpus()}, {SNAPSHOTS} select coalesce(o.relative_path, n.relative_path) as relative_path,
      case when o.content is null then 'added' when n.content is null then 'deleted' when o.content = n.content then 'same' else 'changed' end as change
      from old o full join new n on o.relative_path = n.relative_path""",
    "snapshot_refresh": f"""with {corpus()}, {SNAPSHOTS} select n.relative_path, n.content,
      case when o.content = n.content then -strlen(o.content) else strlen(n.content) end as size,
      case when o.content = n.content then 'kept' else 'taken' end as origin from new n left join old o on o.relative_path = n.relative_path""",
    "snapshot_descent": f"""with {corpus()}, {SNAPSHOTS} select coalesce(o.relative_path, n.relative_path) as relative_path,
      case when o.content is null then 'added' when n.content is null then 'deleted' else 'changed' end as change
      from old o full join new n on o.relative_path = n.relative_path where o.content is distinct from n.content""",
    "snapshot_descent_refresh": f"""with {corpus()}, {SNAPSHOTS} select n.relative_path, n.content,
      case when o.content = n.content then -strlen(o.content) else strlen(n.content) end as size,
      case when o.content = n.content then 'kept' else 'taken' end as origin from new n left join old o on o.relative_path = n.relative_path""",
    "url_normalise": f"""with {urls(PAGE_HINT)} select page_id, url,
      case when way in (1, 2) then 'folder' when way = 3 then 'download' when {IS_GIT} then 'clone' else 'local' end as kind,
      {owner_of('clone_url')} as owner, {repo_of('clone_url')} as repo,
      clone_url, branch, subdirectory, sha256(coalesce(clone_url, url)) as cache_key from parsed""",
    "url_dedup": f"""with {urls('null::varchar')} select clone_url, count(*) as mentions, sha256(clone_url) as cache_key
      from parsed where clone_url is not null group by clone_url""",
    "input_kinds": f"""with {urls('null::varchar')} select page_id, {IS_GIT} as is_git,
      case when way in (1, 2) then 'folder' when {IS_GIT} then 'clone' else 'local' end as kind from parsed""",
    "tree_listing": f"with {corpus()} select relative_path, {MIXED_SIZE} as size from corpus",
    "tree_unignored": f"with {corpus()}, {FILES}, {ignoring(rule_values(RULE_ROWS))} select relative_path, {MIXED_SIZE} as size from corpus where {KEPT}",
    "tree_source": f"""with {corpus()}, t as (select *, len(string_split(relative_path, '/'))::int as depth, {MIXED_SIZE} as bytes, md5({MIXED_BLOB}) as digest from corpus)
      select relative_path, depth, bytes as size, digest, null::varchar as error from t
      where depth <= 3 and bytes <= 2000 and starts_with(relative_path, 'en/') and not ends_with(relative_path, '.log')""",
    "tree_chunks": f"""with {corpus()}, d as (select *, {MIXED_DECODED} as x, {MIXED_TEXT} as ok from corpus)
      select relative_path, not ok as is_binary, case when ok then {line_count('x')} else 0 end as lines,
        case when ok then strlen(x) else {MIXED_SIZE} end as characters, case when ok then {word_count('x')} else 0 end as words from d""",
    "single_file": f"""with {corpus()}, d as (select *, {MIXED_DECODED} as x, {MIXED_TEXT} as ok, {MIXED_SIZE} as bytes from corpus
        order by {MIXED_SIZE} desc, relative_path limit 1)
      select string_split(relative_path, '/')[-1] as relative_path, bytes as size, true as is_process_last, not ok as is_binary,
        case when ok then {line_count('x')} else 0 end as lines, case when ok then strlen(x) else bytes end as characters,
        case when ok then {word_count('x')} else 0 end as words from d""",
    "tree_contents": f"with {corpus()} select relative_path, md5({MIXED_BLOB}) as digest, null::varchar as error from corpus",
    "tree_digest": f"""with {corpus()}, d as (select *, {MIXED_DECODED} as x from corpus)
      select relative_path, {MIXED_SIZE} as size, {line_count('x')} as lines, strlen(x) as characters, {word_count('x')} as words
      from d where {MIXED_TEXT} and not ends_with(relative_path, '.log')
        and relative_path not like '%/target/%' and not {LOCKED} and {NOT_VCS}""",
    "unreadable_files": f"""with {corpus()}, d as (select *, regexp_matches(relative_path, '[05]/') as failed from corpus)
      select relative_path, case when not failed then md5({MIXED_BLOB}) end as digest, failed from d""",
    "stream_clean_long_rules": f"""{STREAMED} and {KEPT}) select relative_path, clean as processed_content, {line_count('t')} as lines,
      {word_count('t')} as words from done""",
    "stream_clean": f"""{STREAMED} and {KEPT}) select relative_path, clean as processed_content, {line_count('t')} as lines,
      {word_count('t')} as words from done""",
    "stream_clean_rule_table": f"""{STREAMED} and {KEPT}) select relative_path, clean as processed_content, {line_count('t')} as lines,
      {word_count('t')} as words from done""",
    "stream_documents": f"{STREAMED}), {document('done', text='clean', item=COUNTED_ITEM)} {document_lines()}",
}
