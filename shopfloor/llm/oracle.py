"""DuckDB SQL of the queries that SQL can express."""

TOPK_SQL = """
with whole as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.r <> c.r and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), ranked as (
  select query_id, row_number() over (partition by r order by score desc, vec_id)::int as "rank", vec_id, score
  from scored
)
select * from ranked where "rank" <= 5
"""

QUALITY_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), word as (
  select r, unnest(w) as w, generate_subscripts(w, 1) as i
  from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs)
), windowed as (
  select r, i, w, lead(w, 1) over p as w1, lead(w, 2) over p as w2 from word window p as (partition by r order by i)
), counted as (
  select r, i, w2 is not null and count(*) over (partition by r, w, w1, w2) > 1 as again from windowed
), covered as (
  select r, again or coalesce(lag(again, 1) over p, false) or coalesce(lag(again, 2) over p, false) as c
  from counted window p as (partition by r order by i)
), words as (
  select r, count(*) as n_words, count(*) filter (c) as n_repeat_words from covered group by r
), line as (
  select r, unnest(l) as l, generate_subscripts(l, 1) as i from (select r, string_split(t, chr(10)) as l from docs)
), told as (
  select r, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as w,
    row_number() over (partition by r, l order by i) > 1 as again
  from line
), judged as (
  select r, len(w) as n, again,
    (len(w) < 20 and not regexp_matches(l, '[.!?:;…。！？»”]["'')\]]*[\x20\x09-\x0D]*$'))
    or 10 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > len(w)
    or (len(w) >= 3 and length(regexp_replace(l, '[^A-Z]', '', 'g')) > length(regexp_replace(l, '[^a-z]', '', 'g')))
    or (len(w) >= 10 and 3 * len(list_distinct(w)) < len(w))
    or (len(string_split(lower(l), ' | ')) + len(string_split(lower(l), ' > ')) + len(string_split(lower(l), ' » '))
      + len(string_split(lower(l), ' › ')) + len(string_split(lower(l), ' · ')) - 5 >= 2)
    or (len(w) <= 10 and regexp_matches(lower(l), 'skip to content|sign in|log in|sitemap|main menu|home page|next page|previous page|read more|click here|back to top|share this|zum inhalt|weiterlesen|nach oben|ir al contenido|seguir leyendo|haz clic|aller au contenu|lire la suite|se connecter|cliquez ici'))
    or (len(w) <= 40 and regexp_matches(lower(l), 'all rights reserved|privacy policy|terms of use|terms of service|cookie|javascript|lorem ipsum|subscribe to|newsletter|alle rechte vorbehalten|nutzungsbedingungen|impressum|todos los derechos reservados|aviso legal|tous droits|conditions d''utilisation'))
    as bad
  from told where len(w) > 0
), lines as (
  select r, count(*) filter (again) as n_dup_lines, count(*) filter (again or bad) as n_failed_lines,
    coalesce(sum(n) filter (not again and not bad), 0) as n_words_left
  from judged group by r
), figures as (
  select doc_id, coalesce(n_words, 0) as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(n_words_left, 0)::bigint as n_words_left
  from docs left join words using (r) left join lines using (r)
), verdict as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from figures
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (n_words - n_words_left) <= 50 * n_words as kept, n_failed_lines, n_words_left
from verdict
"""

AUDIT_SQL = r"""
with docs as (
  select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    coalesce(l.quality, 0) = 1 as good, coalesce(l.toxic, 0) = 1 as toxic
  from documents d left join (
    select doc_id, max(case when quality = 1 then 1 else 0 end) as quality, max(case when toxic = 1 then 1 else 0 end) as toxic
    from labels group by doc_id
  ) l using (doc_id)
), split as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from docs
), failed as (
  select part, good, toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > least then 'E' else '' end as f
  from split
), counted as (
  select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed group by part, f
), letter(x) as (
  values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select filter_order, step::int as step, substr(filter_order, step, 1) as x, left(filter_order, step - 1) as earlier
  from orders, generate_series(1, 5) g(step)
), met as (
  select part, filter_order, step, x, n, good, toxic, f, contains(f, x) as fails,
    len(list_filter(string_split(earlier, ''), lambda y: y <> '' and contains(f, y))) > 0 as gone
  from counted, steps
), report as (
  select part, filter_order, step, x,
    coalesce(sum(n) filter (not gone and not fails), 0) as kept,
    coalesce(sum(n) filter (not gone and fails), 0) as removed,
    coalesce(sum(n) filter (gone and fails), 0) as redundant,
    coalesce(sum(n) filter (f = x), 0) as unique_fails,
    coalesce(sum(good) filter (not gone and fails), 0) as good_lost,
    coalesce(sum(toxic) filter (not gone and fails), 0) as toxic_lost
  from met group by part, filter_order, step, x
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley
from report
"""

DEDUP_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents
), ranked as (
  select doc_id, body, row_number() over same as place, first_value(doc_id) over same as keep_id,
    count(*) over (partition by body) as group_size
  from docs window same as (partition by body order by length(t) desc, doc_id nulls last, t)
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from ranked
"""
