"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bit_sliced import top_k
from .byte_bpe import encode_decode
from .collocations import collocations
from .conversation_repair import damage, repair_conversations
from .language_id import identify_languages
from .license_scan import license_digest, scan_licenses
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .order_minhash import compare_with_edits
from .sharding import shard_documents
from .substring_dedup import remove_repeated_windows
from .textops import documents
from .toxicity import score_toxicity
from .word_bpe import encode_decode_words


def held_out():
    """Rows whose labels stay out of training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def tokenizer() -> tuple[str, str]:
    """The rank file and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def word_tokenizer() -> str:
    """The tokenizer file with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark, sf_dir):
    return license_digest(scan_licenses(documents(spark, sf_dir)))


def op2_language_id(spark, sf_dir):
    found = identify_languages(documents(spark, sf_dir, "doc_id", "text", "lang"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(documents(spark, sf_dir), labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark, sf_dir):
    ranks, pattern = tokenizer()
    return encode_decode(documents(spark, sf_dir), ranks, pattern, digest=True)


def op5_bit_sliced_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))


def op7_order_minhash(spark, sf_dir):
    return compare_with_edits(documents(spark, sf_dir))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir, "doc_id", "text", "source"))


def op10_substring_dedup(spark, sf_dir):
    cut = remove_repeated_windows(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir, "lang", "text"))


def op12_conversation_repair(spark, sf_dir):
    return repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_word_bpe(spark, sf_dir):
    return encode_decode_words(documents(spark, sf_dir), word_tokenizer(), digest=True)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_toxicity, op4_byte_bpe, op5_bit_sliced_top_k, op6_sharding, op7_order_minhash, op8_near_duplicates, op9_mixing, op10_substring_dedup, op11_collocations, op12_conversation_repair, op13_word_bpe)}

#: DuckDB twins of the operators that SQL can express.
SQL: dict[str, str] = {
    "op5_bit_sliced_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
                   where embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
              from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op8_near_duplicates": """
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
        e as (select doc_id, unnest(s) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
        l as (select a, b from p join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)),
        g as (select a, b from l union all select b, a from l),
        r(node, root) as (select doc_id, doc_id from s union select g.b, r.root from r join g on g.a = r.node)
        select s.doc_id, len(s.s)::bigint as n_shingles, min(r.root) as component_id, s.doc_id = min(r.root) as kept
        from s join r on r.node = s.doc_id group by s.doc_id, s.s
    """,
    "op10_substring_dedup": """
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        i as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w),
        h as (select doc_id, i, x, array_to_string(list(x) over (partition by doc_id order by i rows between current row and 12 following), ' ') as y,
                     count(*) over (partition by doc_id order by i rows between current row and 12 following) as n from i),
        d as (select doc_id, i, x, n = 13 and min(doc_id) over (partition by y, n = 13) < doc_id as gone from h),
        k as (select doc_id, i, x, bool_or(gone) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from d),
        t as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(x, ' ' order by i) filter (not gone), '') as kept from k group by doc_id)
        select w.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from w left join t using (doc_id)
    """,
    "op11_collocations": """
        with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
        g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
              from w, (values (1), (2), (3), (4)) as v(k)),
        f as (select lang, k, phrase, count(*) as a from g group by all),
        n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
        c as (select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 30),
        cuts as (select c.lang, c.k, c.phrase, c.a, c.w, j, array_to_string(c.w[1:j], ' ') as head, array_to_string(c.w[j + 1:], ' ') as tail
                 from c, (values (1), (2), (3)) as v(j) where j < c.k),
        s as (select cuts.*, l.a as l, r.a as r, ((2000000::hugeint * cuts.a) // (l.a + r.a))::bigint as score
              from cuts join f l on l.lang = cuts.lang and l.phrase = cuts.head and l.k = j join f r on r.lang = cuts.lang and r.phrase = cuts.tail and r.k = cuts.k - j),
        b as (select *, row_number() over (partition by lang, phrase order by score, j) as pick from s),
        inner_ as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, a from c, (values (2), (3)) as v(m), (values (1), (2), (3)) as u(i) where m < k and i + m - 1 <= k),
        x as (select lang, phrase, max(a) as outer_ from inner_ group by all),
        o as (select b.lang, b.phrase, b.a, l, r, score from b left join x using (lang, phrase) where pick = 1 and (outer_ is null or 100::hugeint * outer_ < 80::hugeint * b.a)),
        t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
        select t.lang, rank, phrase, a, l, r, n.n, score from t join n using (lang) where rank <= 2000
    """,
    "op12_conversation_repair": """
        with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
        b as (select *, list_transform(string_split(key, ''), lambda c: ascii(c)) as bytes from k),
        h as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda x: x::bigint)), lambda crc, x:
                list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end))) as crc from b),
        d as (select conv_id, turn, case when m = 4 then 'user' else role end as role,
                     case when m = 1 then '' when m = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                     unnest(case when m = 0 then [] when m = 3 then [1, 2] else [1] end) as copy
              from (select *, xor(crc, 4294967295) % 20 as m from h)),
        r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i from d),
        s as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, lag(role) over (partition by conv_id order by i) as before_, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as tail from r),
        f as (select *, case when tail = '' then 'blank' when seen > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault from s),
        t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
                     count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                     count(*) filter (i > 1 and left(before_, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal, max(i) as n from f group by conv_id),
        ins as (select * from (values (0, 0, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', 'user:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:'),
                (2, 2, '', ''), (2, 3, 'I', 'assistant:'), (2, 2, 'II', 'assistant:' || chr(10) || 'user:'), (3, 3, '', ''), (3, 2, 'I', 'user:'), (3, 3, 'II', 'user:' || chr(10) || 'assistant:')) as v(g, g2, edits, added)),
        p as (select conv_id, 0::bigint as i, 0 as g, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} as best from t
              union all
              select conv_id, i, g, min(best) as best from (
                  select p.conv_id, f.i, e.g,
                         {'cost': p.best.cost + 5 * length(n.edits) + e.cost, 'audit': p.best.audit || n.edits || e.edit,
                          'lines': p.best.lines || case when n.edits = '' then [] else [n.added] end || e.line} as best
                  from p join ins n on n.g = p.g join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1,
                  lateral (select n.g2 as g, 2 as cost, 'D' as edit, []::varchar[] as line
                           union all select case when n.g2 = 2 then 3 else 2 end, 1 + case when f.fault = '' then 0 else 5 end, 'R', [case when n.g2 = 2 then 'assistant:' else 'user:' end || f.text] where f.fault in ('', 'truncated')
                           union all select case left(f.role, 1) when 's' then 1 when 'u' then 2 else 3 end, case when f.fault = '' then 0 else 5 end, 'K', [f.role || ':' || f.text]
                               where f.fault in ('', 'truncated') and (n.g2, left(f.role, 1)) in ((0, 's'), (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u'))) e) group by conv_id, i, g),
        z as (select p.conv_id, min({'cost': p.best.cost + 5 * length(n.edits), 'audit': p.best.audit || n.edits, 'lines': p.best.lines || case when n.edits = '' then [] else [n.added] end}) as best
              from p join t on t.conv_id is not distinct from p.conv_id and t.n = p.i join ins n on n.g = p.g and n.g2 in (0, 3) group by p.conv_id)
        select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(z.best.cost, 0) as cost, coalesce(z.best.audit, '') as audit, sha256(coalesce(array_to_string(z.best.lines, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) c left join t on t.conv_id is not distinct from c.conv_id left join z on z.conv_id is not distinct from c.conv_id
    """,
}
