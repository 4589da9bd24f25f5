r"""The same results in plain SQL (DuckDB dialect), built independently of the operators.

Patterns are the RE2 forms with \b; on the ASCII log lines they find the same spans.
"""

from veilmap.functions import patterns as P
from veilmap.functions.pools import ACCOUNT_STEMS, HOST_WORDS
from veilmap.plans.corpora import LOG_LINES_SQL

_ADDRESS = (r"(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}"
            r"|192\.168\.\d{1,3}\.\d{1,3})")
RX = {
    "ipv4": rf"\b{_ADDRESS}\b",
    "cidr": rf"\b{_ADDRESS}/(?:[0-9]|[1-2][0-9]|3[0-2])\b",
    "fqdn": r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b",
    "netbios": r"\b[A-Za-z0-9](?:[A-Za-z0-9-]{0,13}[A-Za-z0-9])?\b",
    "upn": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "guid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "sid": r"\bS-1-5-21-\d+(?:-\d+)+\b",
    "mac": r"\b(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}\b",
    "unc": r"\\\\[A-Za-z0-9._-]+\\[A-Za-z0-9._$-]+(?:\\[A-Za-z0-9._$-]+)*",
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _spans(name: str, rx: str, source: str = "lines", key: str = "line_id", text: str = "line") -> str:
    """CTE of (key, value, start_pos, end_pos) for the matches of one pattern."""
    return f"""{name} as (
  select {key}, m[i] as value, p as start_pos, p + length(m[i]) as end_pos from (
    select {key}, m, i, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as p
    from (select {key}, m, g, unnest(range(1, len(m) + 1)) as i from (
      select {key}, regexp_extract_all({text}, '{rx}') as m,
             regexp_split_to_array({text}, '{rx}') as g from {source}))))"""


_VALID_IP = "list_aggregate(list_transform(string_split({}, '.'), lambda o: cast(o as int)), 'max') <= 255"
_PLAUSIBLE = (
    "length({v}) > 1 and not regexp_full_match({v}, '[0-9]+') "
    "and length(translate({v}, '" + 
    P.ILLEGAL_HOST_CHARS.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', '')) = length({v}) "
    "and not (contains({v}, '.') and list_last(string_split(lower({v}), '.')) in (" + _quoted(P.FILE_EXTENSIONS) + ")) "
    "and not regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}')")


def _confidence(base: int) -> str:
    window = f"lower(substr(line, cast(greatest(start_pos - {P.CONTEXT_CHARS}, 0) + 1 as bigint), " \
             f"cast(end_pos + {P.CONTEXT_CHARS} - greatest(start_pos - {P.CONTEXT_CHARS}, 0) as bigint)))"
    name = " or ".join(f"contains(lower(value), '{k}')" for k in P.HOST_KEYWORDS)
    near = " or ".join(f"contains({window}, '{p}')" for p in P.CONTEXT_PHRASES)
    return (f"least({base} + case when {name} then 10 else 0 end + case when {near} then 10 else 0 end, 95)"
            " / 100.0")


_KIND_SELECT = {
    "ipv4": f"select line_id, 'ipv4' as t, value, start_pos, end_pos, 1.0 as c from s_ipv4 where {_VALID_IP.format('value')}",
    "cidr": "select line_id, 'cidr' as t, value, start_pos, end_pos, 1.0 as c from s_cidr where "
            + _VALID_IP.format("split_part(value, '/', 1)"),
    "fqdn": f"select line_id, 'hostname' as t, value, start_pos, end_pos, {_confidence(80)} as c "
            f"from s_fqdn join lines using (line_id) where {_PLAUSIBLE.format(v='value')}",
    "nested_netbios": f"select line_id, 'hostname' as t, value, start_pos, end_pos, {_confidence(70)} as c "
                      f"from gated join lines using (line_id) where {_PLAUSIBLE.format(v='value')}",
    "netbios": f"select line_id, 'hostname' as t, value, start_pos, end_pos, {_confidence(70)} as c "
               f"from gated n join lines using (line_id) where {_PLAUSIBLE.format(v='value')} and not exists ("
               "select 1 from s_fqdn f where f.line_id = n.line_id and f.start_pos <= n.start_pos "
               "and n.end_pos <= f.end_pos)",
    "upn": "select line_id, 'upn' as t, value, start_pos, end_pos, 0.9 as c from s_upn "
           f"where lower(split_part(value, '@', 2)) not in ({_quoted(P.PUBLIC_MAIL_DOMAINS)})",
    "guid": "select line_id, 'guid' as t, value, start_pos, end_pos, 1.0 as c from s_guid",
    "sid": "select line_id, 'sid' as t, value, start_pos, end_pos, 1.0 as c from s_sid",
    "mac": "select line_id, 'mac' as t, value, start_pos, end_pos, 1.0 as c from s_mac",
    "unc": "select line_id, 'unc' as t, value, start_pos, end_pos, 0.85 as c from s_unc",
}
_ALL = ("ipv4", "cidr", "fqdn", "netbios", "upn", "guid", "sid", "mac", "unc")

_GATED = ("gated as (select * from s_netbios where contains(value, '-') or (length(value) >= 4 "
          "and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]') "
          "and not regexp_matches(value, '[a-z]')))")
_BASE = ("with lines as (" + LOG_LINES_SQL + "), "
         + ", ".join(_spans(f"s_{k}", rx) for k, rx in RX.items()) + ", " + _GATED + ", "
         + ", ".join(f"k_{k} as ({sql})" for k, sql in _KIND_SELECT.items()))
_FINDING = ("identifier_type, value, cast(start_pos as integer) as start_pos, "
            "cast(end_pos as integer) as end_pos, cast(c as double) as confidence")


def _union(kinds) -> str:
    return " union all ".join(f"select * from k_{k}" for k in kinds)


def _found(*kinds: str) -> str:
    return f"{_BASE} select line_id, {_FINDING.replace('identifier_type', 't as identifier_type')} from ({_union(kinds)})"


_IN_UPN = ("exists (select 1 from k_upn u where u.line_id = f.line_id and u.start_pos <= f.start_pos "
           "and f.end_pos <= u.end_pos)")
_SCAN = (_BASE + f", found as ({_union(_ALL)}), "
         f"outside as (select * from found f where not (t = 'hostname' and {_IN_UPN})), "
         "scanned as (select * from outside qualify row_number() over "
         "(partition by line_id, t, value order by start_pos) = 1), "
         "ids as (select t, value, arg_min(c, (line_id, start_pos)) as c from scanned group by all)")


# -- maps --------------------------------------------------------------------------

def _hex(start: int, length: int) -> str:
    return f"cast('0x' || substr(h, {start}, {length}) as bigint)"


_MASKED = ("(case when starts_with(lower({d}), 'fabrikam.') then 'contoso.' else 'fabrikam.' end "
           "|| list_last(string_split({d}, '.')))")
_HOST_PARTS = ("case when strpos(v, '.') > 0 then substr(v, strpos(v, '.') + 1) end")


def _labels(name: str, types: str) -> str:
    words = _quoted(HOST_WORDS)
    return (f"{name} as (select t, v, h, 'SRV-' || word || '-' || case when n < 100 then lpad(cast(n as varchar), 2, '0') "
            f"else cast(n as varchar) end as label from (select *, row_number() over (partition by word order by h, v) as n "
            f"from (select *, [{words}][{_hex(1, 2)} % {len(HOST_WORDS)} + 1] as word from hashed where t in ({types}))))")


_MASK = "case when contains(v, '/') then split_part(v, '/', 2) else '' end"
_PREFIX = "split_part(v, '.', 1) || '.' || split_part(v, '.', 2)"
_GENERATE = (
    _SCAN + ", hashed as (select t, value as v, md5(value) as h from ids), "
    # addresses: k-th free slot per prefix and mask
    f"asked as (select t, v, {_PREFIX} as p, {_MASK} as k, row_number() over (partition by {_PREFIX}, {_MASK} order by h, v) as n "
    "from hashed where t in ('ipv4', 'cidr')), "
    "spots as (select p, k, s, row_number() over (partition by p, k order by s) as n from ("
    "  select p, k, s, p || '.' || (s // 254 + 1) || '.' || (s % 254 + 1) || case when k = '' then '' else '/' || k end as a "
    "  from (select distinct p, k from asked), range(64516) r(s)) where a not in (select v from hashed)), "
    "f_ip as (select t, v, p || '.' || (s // 254 + 1) || '.' || (s % 254 + 1) || case when k = '' then '' else '/' || k end as f "
    "from asked join spots using (p, k, n)), "
    + _labels("lab", "'hostname', 'unc'") + ", " + _labels("lab_host", "'hostname'") + ", " + _labels("lab_unc", "'unc'") + ", "
    "f_host as (select t, v, label || case when strpos(v, '.') > 0 and regexp_matches(v, '[A-Za-z]+$') then '.' || "
    + _MASKED.format(d=f"({_HOST_PARTS})") + " else '' end as f from lab where t = 'hostname'), "
    "f_keep as (select t, v, label || case when strpos(v, '.') > 0 then substr(v, strpos(v, '.')) else '' end as f from lab_host), "
    "f_upn as (select t, v, stem || case when n < w then lpad(cast(n as varchar), cast(d as int), '0') else cast(n as varchar) end || '@' || "
    + _MASKED.format(d="split_part(v, '@', 2)") + " as f from (select *, case when stem = 'user' then 3 else 2 end as d, "
    "case when stem = 'user' then 1000 else 100 end as w from (select *, "
    "row_number() over (partition by stem order by h, v) + coalesce((select max(cast(regexp_extract(o.value, '^[a-z]+([0-9]+)@', 1) as bigint)) "
    "from ids o where regexp_matches(o.value, '^' || stem || '[0-9]{1,15}@')), 0) as n from ("
    f"select *, [{_quoted(ACCOUNT_STEMS)}][{_hex(5, 2)} % {len(ACCOUNT_STEMS)} + 1] as stem from hashed where t = 'upn')))), "
    "f_guid as (select t, v, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || "
    "substr('89ab', cast(cast('0x' || substr(u, 17, 1) as bigint) % 4 + 1 as bigint), 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) as f "
    "from (select t, v, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(v)) as u from hashed where t = 'guid')), "
    "f_sid as (select t, v, 'S-1-5-21-' || array_to_string(list_transform(range(1, len(string_split(v, '-')) - 3), "
    "lambda i: cast(cast('0x' || substr(sha256(h || '-' || i), 1, 13) as bigint) % 3294967296 + 1000000000 as varchar)), '-') as f "
    "from hashed where t = 'sid'), "
    # MAC addresses: k-th free slot per vendor prefix, slots in multiplicative order
    "mac_asked as (select t, v, lower(substr(v, 1, 9)) as p, row_number() over (partition by lower(substr(v, 1, 9)) order by h, v) as n from hashed where t = 'mac'), "
    "mac_spots as (select p, a, row_number() over (partition by p order by s) as n from (select p, s, p || substr(x, 1, 2) || ':' || substr(x, 3, 2) || ':' || substr(x, 5, 2) as a "
    "from (select p, s, lpad(lower(to_hex(s * 7368787 % 16777216)), 6, '0') as x from (select distinct p from mac_asked), range((select 2 * count(*) from mac_asked)) r(s))) "
    "where a not in (select lower(v) from mac_asked)), "
    "f_mac as (select t, v, a as f from mac_asked join mac_spots using (p, n)), "
    + ", ".join(
        f"{name} as (select t, v, '\\\\' || label || '\\Share' || cast({_hex(9, 4)} % 99 + 1 as varchar) || "
        r"case when ends_with(split_part(v, '\', 4), '$') then '$' else '' end || "
        r"case when len(string_split(v, '\')) > 4 then '\' || array_to_string((string_split(v, '\'))[5:], '\') else '' end as f "
        f"from {source} where t = 'unc')" for name, source in (("f_unc", "lab"), ("f_unc_only", "lab_unc")))
    + ", full_map as materialized (select * from f_ip union all select * from f_host union all select * from f_upn union all select * from f_guid "
    "union all select * from f_sid union all select * from f_mac union all select * from f_unc), "
    "approved as materialized (select * from full_map where t in ('ipv4', 'cidr', 'mac', 'unc')), "
    "global_map as (select t, v, f, 'global' as sc, true as pf from full_map where t <> 'sid'), "
    "project as (select 'hostname' as t, v, 'project-' || f as f, 'project' as sc, true as pf from full_map where t in ('ipv4', 'cidr') "
    "union all select t, v, f, 'project', true from full_map where t = 'sid'), "
    "merged as (select * from global_map where v not in (select v from project) union all select * from project), "
    "kept as (select * from project where v not in (select v from global_map) union all select * from global_map)")
_ENTRY = "t as identifier_type, v as original_value, f as anonymized_value"
_ROW = _ENTRY + ", sc as scope, pf as preserve_format"


def _map_rows(source: str, columns: str = _ENTRY) -> str:
    return f"{_GENERATE} select {columns} from {source}"


def _fake(source: str, where: str = "true") -> str:
    return f"{_GENERATE} select {_ENTRY} from {source} where {where}"


# Occurrences of keys are all substrings of a line that are as long as some key; per start
# the longest stays, and a fold from left to right drops what overlaps.
def _replace(name: str, source: str, pairs: str) -> str:
    return (
        f"{name}_pairs as materialized ({pairs}), "
        f"{name}_sizes as materialized (select distinct cast(length(o) as bigint) as n from {name}_pairs), "
        f"{name}_probes as materialized (select line_id, i - 1 as s, i - 1 + n as e, substr(line, i, n) as o from ("
        f"select line_id, line, unnest(range(1, length(line) + 1)) as i from {source}), {name}_sizes "
        "where i + n - 1 <= length(line)), "
        f"{name}_hits as materialized (select line_id, s, e, o, r from {name}_probes join {name}_pairs using (o)), "
        f"{name}_longest as materialized (select * from {name}_hits qualify row_number() over "
        "(partition by line_id, s order by e desc) = 1), "
        f"{name}_taken as materialized (select line_id, list_reduce(list([struct_pack(s, e, o, r)] order by s), "
        "lambda a, b: case when b[1].s >= a[-1].e then a || b else a end) as t "
        f"from {name}_longest group by line_id), "
        f"{name} as (select line_id, case when t is null then line else array_to_string(list_transform("
        "range(1, len(t) + 1), lambda i: substr(line, case when i = 1 then 1 else t[i - 1].e + 1 end, "
        "t[i].s - case when i = 1 then 0 else t[i - 1].e end) || t[i].r), '') || substr(line, t[-1].e + 1) end as line "
        f"from {source} left join {name}_taken using (line_id))")


_ANON = _GENERATE + ", " + _replace("anon", "lines", "select v as o, f as r from approved")
_REVEALED = _ANON + ", " + _replace("back", "anon", "select f as o, v as r from approved")
_HIT = ("line_id, cast(s as integer) as start_pos, cast(e as integer) as end_pos, "
        "o as original_value, r as anonymized_value")

_TREE = ("tree as (select 'd' || (line_id % 3) || '/' || case (line_id // 100) % 5 when 1 then '_' when 2 then '.' else '' end "
         "|| 'part' || (line_id // 100) || case when (line_id // 100) % 7 = 0 then '.LOG' else '.log' end as relative_path, "
         "(line_id // 100) % 11 <> 3 as success, string_agg(line, chr(10) order by line_id) as text from {} group by all)")


# RE2 takes only ASCII letters for word characters.  Other letters and numbers become
# underscores, one for one, so word borders and positions agree.
_ASCII_WORDS = r"regexp_replace({}, '[^\P{{L}}A-Za-z]|[^\P{{N}}0-9]', '_', 'g')"


def _running_spans(name: str, rx: str) -> str:
    """`_spans` by a running sum, for texts with many matches."""
    return f"""{name} as (
  select line_id, value, cast(sum(length(gap) + before) over w as bigint) as start_pos,
         cast(sum(length(gap) + before) over w + length(value) as bigint) as end_pos from (
    select line_id, i, gap, value, coalesce(length(lag(value) over (partition by line_id order by i)), 0) as before from (
      select line_id, unnest(range(1, len(m) + 1)) as i, unnest(m) as value, unnest(g[1:len(m)]) as gap from (
        select line_id, regexp_extract_all(line, '{rx}') as m, regexp_split_to_array(line, '{rx}') as g from lines)))
  window w as (partition by line_id order by i))"""


def _over_table(table: str, key: str, text: str) -> str:
    """`_BASE` with the texts of a table as lines."""
    return (f"with lines as materialized (select {key} as line_id, {_ASCII_WORDS.format(text)} as line from {table}), "
            + ", ".join(_running_spans(f"s_{k}", rx) for k, rx in RX.items()) + ", " + _GATED + ", "
            + ", ".join(f"k_{k} as ({sql})" for k, sql in _KIND_SELECT.items()))


def _table_found(table: str, key: str, text: str, names: str) -> str:
    """Findings of all kinds over a text table; `names` gives the key columns back."""
    return (f"{_over_table(table, key, text)} select {names}, "
            f"{_FINDING.replace('identifier_type', 't as identifier_type')} from ({_union(_ALL)})")


ORACLES = {
    "detect_ipv4": _found("ipv4"),
    "validate_rfc1918": _BASE + r""" select line_id, value, len(o) = 4 and list_max(o) <= 255 and (o[1] = 10
        or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168)) as valid
        from (select line_id, value, list_transform(string_split(value, '.'), lambda x: cast(x as bigint)) as o from (
        select line_id, unnest(regexp_extract_all(line, '[0-9]+(?:\.[0-9]+)+')) as value from lines))""",
    "detect_cidr": _found("cidr"),
    "cidr_parts": _BASE + r""" select line_id, value,
        case when cast(split_part(value, '/', 2) as int) > 32 then 'invalid prefix length' end as error,
        case when cast(split_part(value, '/', 2) as int) <= 32 then split_part(value, '/', 1) end as ip,
        case when cast(split_part(value, '/', 2) as int) <= 32 then cast(split_part(value, '/', 2) as int) end as prefix
        from (select line_id, unnest(regexp_extract_all(line, '[0-9.]+/[0-9]+')) as value from lines)""",
    "detect_fqdn": _found("fqdn"),
    "detect_netbios": _found("nested_netbios"),
    "hostname_fp_filter": _BASE + " select line_id, value from (select line_id, unnest(string_split(line, ' ')) as value "
                          "from lines) where " + _PLAUSIBLE.format(v="value"),
    "netbios_outside_fqdn": _found("netbios"),
    "hostname_confidence": _BASE + " select value, cast(c as double) as confidence, count(*) as n from ("
                           + _union(("fqdn", "netbios")) + ") group by value, c",
    "detect_hostname": _found("fqdn", "netbios"),
    "detect_upn": _found("upn"),
    "detect_guid": _found("guid"),
    "detect_sid": _found("sid"),
    "detect_identity": _found("upn", "guid", "sid"),
    "detect_mac": _found("mac"),
    "detect_unc": _found("unc"),
    "detect_network": _found("mac", "unc"),
    "detect_all_raw": _found(*_ALL),
    "detect_documents": _table_found("documents", "doc_id", "text", "line_id as doc_id"),
    "detect_pages": _table_found("pages", "page_id", "html", "line_id as page_id"),
    "detect_conversations": _table_found("conversations", "conv_id * 1000000 + turn", "text",
                                         "line_id // 1000000 as conv_id, line_id % 1000000 as turn"),
    "finding_violations": _BASE + f"""
        select array_to_string(list_filter([
          case when c2 not between 0 and 1 then 'confidence out of range' end,
          case when e2 < start_pos then 'end before start' end,
          case when v2 = '' then 'empty value' end,
          case when length(v2) <> e2 - start_pos then 'length differs from span' end], lambda x: x is not null), '; ') as violations,
          count(*) as n
        from (select start_pos, case when d = 0 then c + 1 else c end as c2,
          case when d = 1 then start_pos - 1 else end_pos end as e2, case when d = 2 then '' else value end as v2
          from (select *, (start_pos + length(value)) % 5 as d from ({_union(_ALL)}))) group by 1""",
    "hostname_not_in_upn": _BASE + f" select line_id, {_FINDING.replace('identifier_type', 't as identifier_type')} from ("
                           f"select * from ({_union(('fqdn', 'netbios'))}) f where not {_IN_UPN})",
    "scan_doc_distinct": _BASE + f" select line_id, {_FINDING.replace('identifier_type', 't as identifier_type')} from ("
                         f"select * from ({_union(_ALL)}) qualify row_number() over (partition by line_id, t, value order by start_pos) = 1)",
    "scan_corpus": _SCAN + f" select line_id, {_FINDING.replace('identifier_type', 't as identifier_type')} from scanned",
    "scan_docs_with_hits": f"{_over_table('documents', 'doc_id', 'text')} select distinct line_id as doc_id from ({_union(_ALL)})",
    "scan_unique": _SCAN + " select t as identifier_type, value, cast(c as double) as confidence from ids",
    "scan_report": _SCAN + " select t as identifier_type, value, printf('%.2f', cast(c as double)) as confidence from ids",
    "scan_type_counts": _SCAN + " select t as identifier_type, count(*) as n from ids group by t",
    "scan_approved": _SCAN + " select t as identifier_type, value, cast(c as double) as confidence from ids "
                     "where t in ('ipv4', 'cidr', 'mac', 'unc')",
    "map_violations": _GENERATE + """ select v as original_value, case length(v) % 6 when 0 then 'unknown scope'
        when 1 then 'values identical' when 2 then 'empty anonymized_value' when 3 then 'unknown identifier_type' else '' end
        as violations from full_map""",
    "map_merge": _map_rows("merged", _ROW),
    "map_upsert": _map_rows("kept", _ROW),
    "map_add_manual": _GENERATE + f" select {_ENTRY}, 'project' as scope, true as preserve_format from approved union all "
                      "select 'hostname', 'SQL-PROD-03', 'SRV-MANUAL-01', 'project', true",
    "map_show": _map_rows("merged", _ENTRY + ", sc as scope"),
    "map_projection": _map_rows("merged", "v as original_value, f as anonymized_value"),
    "map_invert": _GENERATE + """ select t as identifier_type, 'fake-' || substr(md5(v), 1, 2) as original_value,
        v as anonymized_value, 'project' as scope, true as preserve_format from full_map
        qualify row_number() over (partition by substr(md5(v), 1, 2) order by v desc) = 1""",
    "map_csv_roundtrip": _map_rows("merged", _ROW),
    "map_load_last_wins": _map_rows("merged", _ROW),
    "generate_map": _map_rows("full_map"),
    "generate_quarantine": _SCAN + r""", damaged as (
        select case when length(value) % 7 = 0 then 'ipv6' else t end as t,
          case when length(value) % 7 = 1 then translate(value, '.@:-\', '') else value end as v from ids),
        judged as (select t, v, case when t = 'ipv6' then 'unknown identifier type'
          when t = 'ipv4' and not regexp_matches(v, '^[^.]*(\.[^.]*){3}$') then 'invalid ipv4'
          when t = 'cidr' and not regexp_matches(v, '^[^./]*(\.[^./]*){3}/[^/]*$') then 'invalid cidr'
          when t = 'upn' and not regexp_matches(v, '^[^@]*@[^@]*$') then 'invalid upn'
          when t = 'sid' and not starts_with(v, 'S-1-5-21-') then 'invalid sid'
          when t = 'mac' and not regexp_matches(v, '^[^:-]*([:-][^:-]*){5}$') then 'invalid mac'
          when t = 'unc' and not regexp_matches(v, '^\\\\[^\\]*\\') then 'invalid unc' end as reason from damaged)
        select t as identifier_type, v as value, reason from judged where reason is not null""",
    "fake_ipv4": _fake("f_ip", "t = 'ipv4'"),
    "fake_ipv4_free": _GENERATE + """, free_asked as (select t, v, row_number() over (order by h, v) as n from hashed where t = 'ipv4'),
        free_spots as (select a, row_number() over (order by s) as n from (select s, case
            when q < 16516096 then '10.' || (q // 64516) || '.' || (q % 64516 // 254 + 1) || '.' || (q % 254 + 1)
            when q < 17556480 then '172.' || ((q - 16516096) // 65024 + 16) || '.' || ((q - 16516096) % 65024 // 254) || '.' || ((q - 16516096) % 254 + 1)
            else '192.168.' || ((q - 17556480) // 254) || '.' || ((q - 17556480) % 254 + 1) end as a
          from (select s, s * 7368787 % 17621504 as q from range((select 2 * count(*) from free_asked)) r(s)))
          where a not in (select v from free_asked))
        select t as identifier_type, v as original_value, a as anonymized_value from free_asked join free_spots using (n)""",
    "fake_cidr": _fake("f_ip", "t = 'cidr'"),
    "fake_hostname": _fake("f_keep"),
    "fake_upn": _fake("f_upn"),
    "fake_guid": _fake("f_guid"),
    "fake_sid": _fake("f_sid"),
    "fake_mac": _fake("f_mac"),
    "fake_unc": _fake("f_unc_only"),
    "fake_uniqueness": _GENERATE + """ select t as identifier_type, count(*) as entries, count(distinct f) as fakes,
        cast(count_if(f in (select v from full_map)) as bigint) as fakes_among_originals from full_map group by t""",
    "map_growth": _GENERATE + """ select t as identifier_type, count(*) as entries,
        cast(count_if(t in ('hostname', 'guid', 'upn')) as bigint) as kept from full_map group by t""",
    "mapped_occurrences": f"{_ANON} select {_HIT} from anon_hits",
    "longest_match": f"{_ANON} select {_HIT} from anon_longest",
    "overlap_resolution": f"{_ANON} select {_HIT} from (select line_id, unnest(t, recursive := true) from ("
                          "select line_id, unnest(t) as t from anon_taken))",
    "anonymize_lines": _ANON + " select line_id, line from anon",
    "stream_grow_and_anonymize": "select line_id, line, true as hidden from (" + LOG_LINES_SQL + ")",
    "anonymize_join": _ANON + " select line_id, line from anon",
    "reveal_lines": _REVEALED + " select line_id, line from back",
    "reveal_full": "select line_id, line from (" + LOG_LINES_SQL + ")",
    "roundtrip_audit": "select count(*) as documents, cast(0 as bigint) as mismatches from events",
    "residual_leaks": _ANON + ", " + _replace("left_over", "anon", "select v as o, f as r from approved")
                      + " select distinct line_id from left_over_hits",
    "generate_unseen": _GENERATE + " select t as identifier_type, count(*) as entries, count(*) as fakes, "
                       "cast(0 as bigint) as collisions from full_map group by 1",
    "map_ambiguous_fakes": _GENERATE + " select 'fake-' || substr(md5(v), 1, 3) as anonymized_value, count(*) as originals "
                           "from full_map group by 1 having count(*) > 1",
    "map_fake_collisions": _GENERATE + """, fakes as (select distinct substr(v, 1, 5) || substr(md5(v), 1, 1) as f from approved)
        select f as anonymized_value, 'in corpus' as reason from fakes
        where exists (select 1 from lines where contains(line, f))
        union all select f, 'is an original' from fakes where f in (select v from approved)""",
    "corpus_ext_filter": """select doc_id, path from (select doc_id, '/data/' || source || '/doc' || doc_id ||
        (['.log', '.TXT', '.md', '.py', '.Ps1', '', '.log.gz'])[doc_id % 7 + 1] as path from documents)
        where lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) in ('.log', '.txt', '.md', '.ps1')""".replace("\\\\", "\\"),
    "corpus_table": "select doc_id, text from documents",
    "corpus_status": _BASE + ", " + _TREE.format("lines") + " select relative_path, success from tree",
    "corpus_relative_path": """select doc_id, '/data/in/' || source || '/doc' || doc_id || '.log' as path,
        source || '/doc' || doc_id || '.log' as relative_path from documents where doc_id % 2 = 0""",
    "anonymize_corpus": _ANON + ", " + _TREE.format("anon") + " select relative_path, md5(text) as md5 from tree where success",
    "reveal_corpus": _BASE + ", " + _TREE.format("lines") + " select relative_path, md5(text) as md5 from tree where success",
    "run_report": _BASE + ", " + _TREE.format("lines") + """ select count(*) as processed,
        cast(count_if(success) as bigint) as success, cast(count_if(not success) as bigint) as failed from tree""",
    "stream_anonymize": _ANON + " select line_id, line from anon",
    "stream_new_identifiers": _SCAN + " select t as identifier_type, value from ids",
    "stream_map_growth": _GENERATE + f" select {_ENTRY}, 'project' as scope, true as preserve_format from full_map",
    "stream_closed_windows": _BASE + ", found as (" + _union(_ALL) + """),
        days as (select date_diff('day', min(ts), max(ts)) + 1 as days, min(ts) as first from events),
        parts as (select event_id, ts, cast(floor(date_diff('day', first, ts) * 4.0 / days) as integer)
            + case when event_id % 10 = 0 then 1 else 0 end as part from events, days),
        marks as (select p.part, max(e.ts) filter (e.part < p.part) - interval 1 hour as mark
            from (select distinct part from parts) p, parts e group by 1),
        placed as (select time_bucket(interval 1 hour, ts) as window_start, t as identifier_type,
            coalesce(time_bucket(interval 1 hour, ts) + interval 1 hour <= mark, false) as late
            from found join parts on event_id = line_id join marks using (part))
        select window_start, identifier_type, late, count(*) as n from placed
        where late or window_start + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by all""",
    "stream_type_window": _BASE + ", found as (" + _union(_ALL) + ") select time_bucket(interval 1 hour, ts) as window_start, "
                          "t as identifier_type, count(*) as n from found join events on event_id = line_id group by all",
}
