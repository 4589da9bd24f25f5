"""SQL twins of the registered queries, where SQL can express them."""

ORACLES = {
    "op8_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length('<turn>' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') || chr(10)
                   || regexp_replace(text, '<(\\*/?turn>)', '<\\\1', 'g') || '</turn>' || chr(10)) as chars
  from turns),
counted as (
  select *, sum(chars) over w as upto, row_number() over w as i, count(*) over (partition by conv_id) as n
  from sized window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (role = 'assistant' or i = n))::bigint as formatted_chars
from counted group by conv_id""",
    "op1_mix_sources": """
with recursive sizes as (
  select source, greatest(sum(length(coalesce(text, ''))), 1)::double as size from documents group by source),
total as (select sum(size) as size, sum(pow(size, 0.5)) as weight from sizes),
rates as (select s.source, pow(s.size, 0.5) * (1.0 * t.size / t.weight) / s.size as rate from sizes s, total t),
means as (select source, greatest(ceil(rate / 16), 1)::int as draws, rate / greatest(ceil(rate / 16), 1) as mean from rates),
cdf as (
  select source, draws, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from means
  union all select source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from cdf where k < 128),
tables as (select source, draws, list(c) filter (p >= 1e-18) as cs from cdf group by source, draws),
counted as (
  select d.*, list_sum(list_transform(range(1, t.draws + 1), lambda j: len(list_filter(t.cs, lambda c: c <=
    ('0x' || substr(md5('mix/' || d.doc_id || '/' || j), 1, 13))::bigint / 4503599627370496.0)))) as n
  from documents d join tables t on d.source is not distinct from t.source),
copies as (select * exclude (n), unnest(range(1, n::bigint + 1))::int as copy from counted where n > 0)
select *, md5('mix/' || doc_id || '/copy/' || copy) as mix_key from copies""",
    "op3_substring_dedup": r"""
with words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, w from (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)),
starts as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as run from words where i + 34 <= len(w)),
again as (select run from starts group by run having count(*) > 1),
hits as (select doc_id, i from starts semi join again using (run)),
told as (
  select w.doc_id, w.i, w.word, coalesce(max(h.i) over (partition by w.doc_id order by w.i) >= w.i - 34, false) as gone
  from words w left join hits h on h.doc_id = w.doc_id and h.i = w.i),
sums as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed,
    coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept
  from told group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join sums s on s.doc_id = d.doc_id""",
    "op10_embedding_dedup": """
with recursive vecs as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id as a, b.vec_id as b from vecs a join vecs b on a.label = b.label and a.vec_id <> b.vec_id
    and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
counted as (select a, count(*) as n from links group by a),
least as (select a, min(b) as b from reach group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, least(e.vec_id, l.b) as component_id,
  e.vec_id = least(e.vec_id, l.b) as kept
from embeddings e left join counted c on c.a = e.vec_id left join least l on l.a = e.vec_id""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- CRC-32 of the decimal id, bit by bit.
hashed AS (
  SELECT conv_id, turns, CAST(xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte:
      list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, bit:
        xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS INTEGER) AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
placed AS (
  SELECT conv_id, size, depth, md5(CAST(turns[1:depth] AS JSON)) AS node, md5(CAST(turns[1:depth - 1] AS JSON)) AS above,
         coalesce(len(regexp_extract_all(turns[depth].text, '[^\x20\x09-\x0D]+')), 0) AS words FROM prefixes),
nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
  FROM placed GROUP BY node, depth),
kids AS (SELECT depth - 1 AS depth, above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
-- Every node with each node over it, by its smallest member, which all nodes over it have as a member.
under AS (
  SELECT a.node, a.depth, sum(n.saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes n JOIN placed a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN kids k ON k.above = n.node AND k.depth = n.depth GROUP BY a.node, a.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN under u ON u.node = n.node AND u.depth = n.depth
LEFT JOIN kids k ON k.above = n.node AND k.depth = n.depth
LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1""",
}
