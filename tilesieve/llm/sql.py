"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from tilesieve.llm.license_scan import PHRASES, TEMPLATES, words_of
from tilesieve.llm.quality_rules import BOILERPLATE, NAVIGATION_WORDS, SENTENCE_MARK, Limits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = "coalesce(text, '')"
WORD = r"[^\x20\x09-\x0D]+"


def lowered(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def template_pattern(template: str) -> str:
    """A template as a pattern over words that are each followed by a blank."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            out += "("
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var;"):
            given = dict(x.split("=", 1) for x in part[2:-2].split(";")[1:])
            out += f"({given['match']}) " if "match" in given else f"([^ ]+ ){{0,{given['max']}}}"
        else:
            out += "".join(w.decode() + " " for w in words_of(part))
    return out


def op3(rules: list[tuple[str, str]], default: str = "allow") -> str:
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')"

    ranked = sorted(rules, key=lambda r: -len(r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in ranked)
    verdict = " ".join(f"when {fits(r)} then '{v}'" for r, v in ranked)
    return f"""with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    raw as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
    parts as (select page_id, {lowered('raw')} as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from raw)
    select page_id, host, path, case {rule} end as rule, case {verdict} else '{default}' end as verdict from parts"""


OP4 = f"""with d as (select doc_id, sha256({lowered(TEXT)}) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256 from d"""

_L = Limits()
OP5 = f"""with d as (select doc_id, {TEXT} as text, regexp_extract_all({TEXT}, '{WORD}') as words from documents),
l as (select doc_id, line, regexp_extract_all(line, '{WORD}') as words from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
own as (select doc_id, line, words, len(words) as n, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols, len(regexp_extract_all(line, '!!+')) as shouts,
  len(regexp_extract_all(line, '[|»›•]')) as bars from l where len(words) > 0),
judged as (select *, (bars >= 3 and n - bars <= 3 * (bars + 1)) or (greatest(symbols, shouts) >= 3 and 10 * greatest(symbols, shouts) > n) or (n >= 30 and not regexp_matches(line, '{SENTENCE_MARK}'))
  or (n <= 8 and list_has_all(string_split('{NAVIGATION_WORDS}', ' '), string_split({lowered("array_to_string(words, ' ')")}, ' '))) or regexp_matches({lowered('line')}, '{'|'.join(BOILERPLATE).replace(chr(39), chr(39) * 2)}') as fails from own),
by_line as (select doc_id, count(*) - count(distinct line) as n_dup_lines, sum(case when fails then list_sum(list_transform(words, lambda w: length(w))) else 0 end) as lost from judged group by 1),
wins as (select doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] as w from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d)),
often as (select doc_id, w from wins group by 1, 2 having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from wins join often using (doc_id, w), (select unnest(range(0, 3)) as k) group by 1),
counts as (select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, coalesce(lost, 0) as lost
  from d left join by_line using (doc_id) left join covered using (doc_id)),
verdicts as (select *, n_words < {_L.min_words} or 100 * n_repeat_words > {_L.max_repeat_percent} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= {_L.max_lost_percent} * word_chars as kept from verdicts"""


def _op6() -> str:
    places = ", ".join(
        f"list_filter(range(0, len(words)), lambda i: {' and '.join(f'''words[i + {k + 1}] = '{w}' ''' for k, w in enumerate(p.split()))}) as {label}" for p, label in PHRASES.items()
    )
    base = ", ".join(f"case when len({label}) > 0 then '{label}' end" for label in PHRASES.values())
    more = ", ".join(f"case when regexp_matches(joined, ' {template_pattern(t)}') then '{label}' end" for label, t in TEMPLATES.items())
    joined = " || ".join(PHRASES.values())
    return rf"""with w as (select doc_id, regexp_extract_all({lowered(TEXT)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
    f as (select doc_id, len(words) as n, ' ' || array_to_string(words, ' ') || ' ' as joined, {places} from w),
    g as (select *, {joined} as places, list_filter([{base}], lambda x: x is not null) as base, list_filter([{more}], lambda x: x is not null) as more from f)
    select doc_id, cast(n as bigint) as n_words, cast(len(places) as bigint) as n_base, cast(list_min(places) as bigint) as first_word, cast(list_max(places) as bigint) as last_word,
      array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(base || more), ',') as labels,
      cast(case when len(more) > 0 then 1.0 when len(places) > 0 then least(9, 4 + len(places)) / 10 else 0.0 end as double) as score from g"""


OP6 = _op6()

OP7 = """with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest, case when n >= 100 then min(page_id) over (partition by html) else page_id end as first from p)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from f"""

OP2 = rf"""with l as (select doc_id, generate_subscripts(parts, 1) as no, unnest(parts) as line from (select doc_id, string_split({TEXT}, chr(10)) as parts from documents)),
d as (select line, length(line) as n, min(cast(doc_id as hugeint) * 10000000 + no) as place from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
halves as (select line, n, place, unnest([greatest(0, (n - 1) // 2), greatest(0, (n - 2) // 2)]) as c from d),
ends as (select distinct line, n, place, c, 'first' as side, left(line, c) as piece from halves union select line, n, place, c, 'last', right(line, c) from halves),
pairs as (select distinct a.line as early, b.line as late, a.n as n from ends a join ends b using (side, c, piece) where a.place < b.place and abs(a.n - b.n) <= 1),
near as (select distinct late as line from pairs where case
  when length(early) = length(late) then len(list_filter(range(1, n + 1), lambda i: substr(early, i, 1) <> substr(late, i, 1))) <= 1
  when length(early) < length(late) then len(list_filter(range(0, length(late)), lambda i: left(early, i) = left(late, i) and substr(early, i + 1) = substr(late, i + 2))) > 0
  else len(list_filter(range(0, length(early)), lambda i: left(early, i) = left(late, i) and substr(late, i + 1) = substr(early, i + 2))) > 0 end),
kept as (select l.doc_id, l.no, l.line, not regexp_matches(l.line, '[^\x20\x09-\x0D]') or (cast(l.doc_id as hugeint) * 10000000 + l.no = d.place and near.line is null) as stays
  from l left join d on l.line = d.line left join near on l.line = near.line)
select doc_id, count(*) as n_lines, cast(count_if(not stays) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by no) filter (stays), '')) as text_sha256 from kept group by 1"""
