"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_MASKED = r"""regexp_replace(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g')"""

LINE_DEDUP_SQL = rf"""
with docs as (select row_number() over () as row_id, doc_id, text from documents),
lines as (select row_id, doc_id, generate_subscripts(string_split(text, chr(10)), 1) as ln,
                 unnest(string_split(text, chr(10))) as line from docs where text is not null),
masked as (select row_id, doc_id, ln, line, {_MASKED} as m from lines),
uniq as (select distinct row_id, doc_id, m, string_split(m, ' ') as t from masked where m <> ''),
keyed as (select row_id, doc_id, m, t, len(t) as n, array_to_string(t[1:3], ' ') as lead from uniq),
leaf as (select n, lead from keyed group by n, lead having count(*) >= 10),
own as (select keyed.* from keyed join leaf using (n, lead)),
tokens as (select row_id, n, lead, m, generate_subscripts(t, 1) as pos, unnest(t) as token from own),
held as (select n, lead, pos, token from tokens where token <> '<*>'
         group by n, lead, pos, token having count(distinct row_id) >= 10),
kept as (select n, lead, m, count(*) as n_fixed,
                string_agg(pos || ':' || token, ' ' order by pos) as template
         from (select distinct n, lead, m, pos, token from tokens) join held using (n, lead, pos, token) group by n, lead, m),
good as (select row_id, doc_id, n, lead, m, template from own join kept using (n, lead, m)
         where n_fixed >= 0.7 * n),
recurring as (select n, lead, template, min(doc_id) as keeper from good
              group by n, lead, template having count(distinct row_id) >= 10),
dropped as (select distinct m, keeper from good join recurring using (n, lead, template)),
marked as (select row_id, ln, line, masked.m,
                  dropped.m is not null and dropped.keeper is distinct from masked.doc_id as goes
           from masked left join dropped on masked.m = dropped.m),
texts as (select row_id, count(*) filter (m <> '') as n_lines, count(*) filter (goes) as n_dropped,
                 string_agg(line, chr(10) order by ln) filter (not goes) as text
          from marked group by row_id)
select d.doc_id, coalesce(x.n_lines, 0) as n_lines, coalesce(x.n_dropped, 0) as n_dropped,
       case when x.row_id is not null then coalesce(x.text, '') end as text
from docs d left join texts x using (row_id)
"""

TOP_K_SQL = """
with ok as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
            from embeddings where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     pairs as (select q.vec_id as query_id, c.vec_id as vec_id,
                      list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
               from (select * from ok where vec_id % 100 = 0) q join ok c on q.vec_id <> c.vec_id),
     ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank,
                       vec_id, score from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
with docs as (select row_number() over () as row_id, doc_id, coalesce({_WORDS}, []) as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
windows as (select distinct item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as s,
                   least(13, len(w)) as n
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i
                  from items where len(w) > 0)),
lengths as (select distinct n from windows),
grams as (select row_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
          from (select row_id, w, n, unnest(range(1, len(w) - n + 2)) as i
                from docs, lengths where len(w) >= n)),
found as (select row_id, i, n, item_id from grams join windows using (n, s)),
hit as (select row_id, count(distinct p) as n_hit
        from (select row_id, unnest(range(i, i + n)) as p from found) group by row_id),
named as (select row_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct row_id, item_id::varchar as item_id from found) group by row_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (row_id) left join named using (row_id)
"""

# CRC-32 byte by byte; the runs' letters have one or two bytes of UTF-8
SPELLING_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
           case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select coalesce(doc_id::varchar, '') as id,
                unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) as run from documents),
lowered as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
            from runs group by all),
bytes as (select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
            case when unicode(c) < 128 then [unicode(c)::bigint]
                 else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)) as b from lowered),
hashed as (select run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x:
             xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, crc),
changed as (select n, case when h % 199 = 0
                           then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
                           else run end as word from hashed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= 6 group by word having sum(n) >= 5),
without as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
            from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word as a, b.word as b, b.n as b_n
         from without a join without b on a.rest = b.rest and a.i = b.i and a.word <> b.word
         union select l.word, s.word, s.n from without l join words s on l.rest = s.word
         union select s.word, l.word, l.n from without l join words s on l.rest = s.word),
best as (select a as word, count(*) as n_near, max(b_n) as form_n, arg_min(b, (-b_n, b)) as form from near group by a),
formed as (select words.word, n, coalesce(n_near, 0) as n_near,
                  case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n
           from words left join best using (word)),
walk as (select word, word as at from formed
         union all select walk.word, formed.form from walk join formed on walk.at = formed.word
         where formed.form is not null),
roots as (select walk.word, walk.at as root from walk join formed on walk.at = formed.word where formed.form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

HARD_NEGATIVES_SQL = """
with rows as (select row_number() over () as r, vec_id,
                     case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                     list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
              from embeddings where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
                  list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
           from rows a join rows b on a.r <> b.r where a.vec_id % 100 = 0),
positive as (select r, anchor_id, vec_id as positive_id, score as positive_score,
                    row_number() over (partition by r order by score desc, vec_id) as p
             from scored where same qualify p <= 5)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score
from (select positive.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
             row_number() over (partition by positive.r, p order by score desc, vec_id) as rank
      from positive join scored on positive.r = scored.r and not same
       and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
where rank <= 10
"""
