"""Tokenizer front ends over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.functions import text as tx
from querylight.operators import merging as mg
from querylight.operators import vocab as vb
from querylight.plans.registry import query, table
from querylight.session import spread, stage, stage_path
from querylight.sources.files import read_tokenizer, read_vocab, write_lines

CLEAN = r"regexp_replace(regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\p{{Cf}}\x{{FFFD}}]', '', 'g'), '[ \t\n\r\p{{Zs}}]', ' ', 'g')"
CJK = r"regexp_replace({}, '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{20000}}-\x{{2A6DF}}\x{{2A700}}-\x{{2B73F}}\x{{2B740}}-\x{{2B81F}}\x{{2B820}}-\x{{2CEAF}}\x{{F900}}-\x{{FAFF}}\x{{2F800}}-\x{{2FA1F}}])', ' \1 ', 'g')"
PUNCT = r"regexp_replace({}, '([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{{P}}])', ' \1 ', 'g')"


def basic_sql(column: str) -> str:
    return PUNCT.format(f"strip_accents(lower({CJK.format(CLEAN.format(column))}))")


def split_sql(text: str) -> str:
    """DuckDB list of the words of a text."""
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def tokens_cte(source: str, key: str, text: str, name: str) -> str:
    """`name(key, pos, token)` over a table or CTE."""
    return f"""{name}_lists as (select {key}, {split_sql(basic_sql(text))} as l from {source}),
    {name} as (select {key}, unnest(range(len(l))) as pos, unnest(l) as token from {name}_lists)"""


VOCAB_CTE = f"""{tokens_cte("documents", "doc_id", "text", "doc_tokens")},
    counts as (select token, count(*) as n from doc_tokens group by token),
    chars as (select distinct unnest(string_split(token, '')) as c from counts),
    listed as (
      select 0 as part, i as rank, t as token from (values (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]')) v(i, t)
      union all select 1, 0, c from chars union all select 2, 0, '##' || c from chars
      union all select 3, -n, token from (select * from counts where length(token) > 1 order by n desc, token limit 2000)),
    vocab as (select row_number() over (order by part, rank, token) - 1 as id, token from listed)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def doc_token_lists(spark, sf_dir):
    """`(doc_id, tokens)`, written once."""
    docs = spread(documents(spark, sf_dir))
    return stage(docs.select("doc_id", tx.basic_tokens(F.col("text")).alias("tokens")), "tokens")


def vocab_and_lists(spark, sf_dir):
    lists = doc_token_lists(spark, sf_dir)
    return stage(vb.build_vocab(lists), "vocab"), lists


def word_counts(spark, sf_dir):
    """`(word, n)`: blank-separated words in lower case."""
    each = spread(documents(spark, sf_dir)).select(F.explode(tx.words(F.lower("text"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


@query("tok_clean", f"select doc_id, {CLEAN.format('text')} as text from documents")
def tok_clean(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", tx.clean(F.col("text")).alias("text"))


# The texts hold no ideographs, so every third one gets some.
WITH_CJK = "case when doc_id % 3 = 0 then '数据库' || text || '查询x〆' else text end"


@query("tok_cjk", f"select doc_id, {CJK.format(WITH_CJK)} as text from documents")
def tok_cjk(spark, sf_dir):
    mixed = documents(spark, sf_dir).selectExpr("doc_id", f"{WITH_CJK} as text")
    return mixed.select("doc_id", tx.isolate_cjk(F.col("text")).alias("text"))


@query("tok_fold", "select doc_id, strip_accents(lower(text)) as text from documents")
def tok_fold(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", tx.strip_accents(F.lower("text")).alias("text"))


@query("tok_punct", f"select doc_id, {PUNCT.format('text')} as text from documents")
def tok_punct(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", tx.space_punctuation(F.col("text")).alias("text"))


@query(
    "tok_basic_counts",
    f"""with {tokens_cte("documents", "doc_id", "text", "doc_tokens")},
    per_doc as (select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct from doc_tokens group by doc_id)
    select 'document' as level, cast(doc_id as varchar) as name, n_tokens, n_distinct from per_doc
    union all select 'language', lang, count(*), count(distinct token)
    from doc_tokens join documents using (doc_id) group by lang""",
)
def tok_basic_counts(spark, sf_dir):
    """Per-document numbers come from the token array itself; per language the distinct tokens of a
    document are counted first, so a language never meets in one task."""
    lists = spread(documents(spark, sf_dir)).select("doc_id", "lang", tx.basic_tokens(F.col("text")).alias("l"))
    lists = stage(lists.withColumn("d", F.array_distinct("l")), "lists")
    per_doc = lists.select(
        F.lit("document").alias("level"),
        F.col("doc_id").cast("string").alias("name"),
        F.size("l").cast("bigint").alias("n_tokens"),
        F.size("d").cast("bigint").alias("n_distinct"),
    ).filter("n_tokens > 0")
    sums = lists.groupBy("lang").agg(F.sum(F.size("l")).alias("n_tokens"))
    kinds = lists.select("lang", F.explode("d").alias("t")).distinct().groupBy("lang").agg(F.count("*").alias("n_distinct"))
    per_lang = sums.join(kinds, "lang").select(F.lit("language").alias("level"), F.col("lang").alias("name"), "n_tokens", "n_distinct")
    return per_doc.unionByName(per_lang)


@query("tok_vocab", f"with {VOCAB_CTE} select id, token from vocab")
def tok_vocab(spark, sf_dir):
    """Built from the documents, written one token per line and read back by line number."""
    built, _ = vocab_and_lists(spark, sf_dir)
    path = stage_path(spark, "vocab-lines")
    # One file, as a line number only exists within a file; the vocabulary size is bounded.
    write_lines(built.orderBy("id").select("token").coalesce(1), path)
    return read_vocab(spark, path)


@query(
    "tok_ids",
    f"""with {VOCAB_CTE}
    select doc_id, string_agg(coalesce(id, 1), ' ' order by pos) as ids
    from doc_tokens left join vocab using (token) group by doc_id""",
)
def tok_ids(spark, sf_dir):
    vocab, lists = vocab_and_lists(spark, sf_dir)
    ids = vb.id_lists(lists, vocab, "doc_id").filter(F.size("ids") > 0)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "tok_wordpiece",
    rf"""with recursive {VOCAB_CTE},
    vocabulary as materialized (select token from vocab),
    words as (select distinct unnest({split_sql("lower(text)")}) as word from documents),
    longest as (select max(length(token)) as m from vocabulary),
    starts as (select word, unnest(range(1, length(word) + 1)) as start from words where length(word) <= 200),
    spans as (select word, start, unnest(range(1, least(m, length(word) - start + 1) + 1)) as len from starts, longest),
    hits as materialized (select word, start, max(len) as len from spans join vocabulary
      on token = case when start > 1 then '##' else '' end || substr(word, start, len) group by word, start),
    walk as (
      select word, 1 as place, '' as pieces from words where length(word) <= 200
      union all
      select w.word, w.place + len, w.pieces || case when w.place > 1 then ' ##' else '' end || substr(w.word, w.place, len)
      from walk w join hits h on h.word = w.word and h.start = w.place)
    select words.word, coalesce(max(pieces) filter (place > length(words.word)), '[UNK]') as pieces
    from words left join walk using (word) group by words.word""",
)
def tok_wordpiece(spark, sf_dir):
    vocab, _ = vocab_and_lists(spark, sf_dir)
    pieces = vb.wordpiece(word_counts(spark, sf_dir), vocab)
    return pieces.select("word", F.array_join("pieces", " ").alias("pieces"))


@query(
    "tok_pair_counts",
    rf"""with words as (select unnest({split_sql("lower(text)")}) as word from documents),
    counts as (select word, count(*) as n from words group by word),
    pairs as (select distinct word, n, substr(word, i, 1) as "left", substr(word, i + 1, 1) as "right"
              from (select word, n, unnest(range(1, length(word))) as i from counts))
    select "left", "right", cast(sum(n) as bigint) as n from pairs group by all""",
)
def tok_pair_counts(spark, sf_dir):
    return vb.pair_counts(word_counts(spark, sf_dir))


# In the oracle every symbol stands between two blanks, so a merge is one text replacement.
@query(
    "tok_bpe",
    f"""with recursive words as (select unnest({split_sql("lower(text)")}) as word from documents),
    counts as materialized (select word, count(*) as n from words group by word),
    pairs as (select distinct word, n, substr(word, i, 1) as l, substr(word, i + 1, 1) as r
              from (select word, n, unnest(range(1, length(word))) as i from counts)),
    merges as materialized (select l, r, row_number() over (order by n desc, l, r) as rank
      from (select l, r, sum(n) as n from pairs group by l, r order by n desc, l, r limit 200)),
    walk as (
      select word, ' ' || array_to_string(string_split(word, ''), '  ') || ' ' as s, 0 as step from counts
      union all
      select word, replace(s, ' ' || m[1] || '  ' || m[2] || ' ', ' ' || m[1] || m[2] || ' '), step + 1
      from (select word, s, step, arg_min([l, r], rank) as m
            from walk join merges on contains(s, ' ' || l || '  ' || r || ' ') group by word, s, step))
    select word, replace(trim(arg_max(s, step)), '  ', ' ') as pieces from walk group by word""",
)
def tok_bpe(spark, sf_dir):
    counts = stage(word_counts(spark, sf_dir), "words")
    merges = vb.top_merges(vb.pair_counts(counts), 200)
    return vb.bpe(counts, merges).select("word", F.array_join("pieces", " ").alias("pieces"))


# DuckDB's expressions cannot look ahead, so the oracle first marks the place before the last blank
# of a run that a word follows; nothing matches the mark.
PLAIN_ORACLE = r"""regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1¤\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}¤]+|\s+')"""
DIGIT_ORACLE = r"""regexp_extract_all(regexp_replace(text, '(\s+)([\t\f ]\S)', '\1¤\2', 'g'),
    '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}¤]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}¤]+[\r\n]*|\s*[\r\n]+|\s+')"""


@query(
    "tok_pretoken",
    f"""with lists as (select doc_id, 'plain' as style, {PLAIN_ORACLE} as l from documents
      union all select doc_id, 'digits', {DIGIT_ORACLE} from documents)
    select doc_id, style, len(l) as n, array_to_string(l, '¦') as tokens from lists""",
)
def tok_pretoken(spark, sf_dir):
    docs = spread(documents(spark, sf_dir))
    both = F.array(
        F.struct(F.lit("plain").alias("style"), tx.pretokens(F.col("text")).alias("l")),
        F.struct(F.lit("digits").alias("style"), tx.pretokens(F.col("text"), single_digits=True).alias("l")),
    )
    each = docs.select("doc_id", F.explode(both).alias("b")).select("doc_id", "b.style", "b.l")
    return each.select("doc_id", "style", F.size("l").alias("n"), F.array_join("l", "¦").alias("tokens"))


# The merge table of a public tokenizer; it is read where it lies.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END_OF_TEXT = "<|endoftext|>"
SHOWN_BYTES = "".join(chr(b) if b in mg.PRINTABLE else mg.BYTES_AS_SHOWN[mg.BYTES_AS_READ.index(chr(b))] for b in range(256)).replace("'", "''")
# Every symbol stands between two blanks, as in `tok_bpe`.
MERGED_CTE = f"""words as materialized (select token, count(*) as n from (select unnest({PLAIN_ORACLE}) as token from documents) group by token),
    tokenizer as materialized (select content::json as j from read_text('{TOKENIZER}')),
    merges as materialized (select pair[1] as l, pair[2] as r, i as rank
      from (select unnest(json_transform(j->'$.model.merges', '[["VARCHAR"]]')) as pair, unnest(range(50000)) as i from tokenizer)),
    ids as materialized (select e.key as piece, e.value as id
      from (select unnest(map_entries(cast(j->'$.model.vocab' as map(varchar, bigint)))) as e from tokenizer)),
    walk as (
      select token, ' ' || array_to_string(list_transform(range(strlen(token)),
        lambda i: substr('{SHOWN_BYTES}', ('0x' || substr(hex(encode(token)), 2 * i::int + 1, 2))::int + 1, 1)), '  ') || ' ' as s, 0 as step from words
      union all
      select token, replace(s, ' ' || m[1] || '  ' || m[2] || ' ', ' ' || m[1] || m[2] || ' '), step + 1
      from (select token, s, step, arg_min([l, r], rank) as m
            from (select token, s, step, unnest(list_zip(parts[:-2], parts[2:])) as p
                  from (select token, s, step, string_split(trim(s), '  ') as parts from walk))
            join merges on l = p[1] and r = p[2] group by token, s, step)),
    merged as materialized (select token, replace(trim(arg_max(s, step)), '  ', ' ') as pieces from walk group by token),
    numbered as materialized (select token, string_agg(coalesce(id, 0), ' ' order by i) as ids
      from (select token, unnest(string_split(pieces, ' ')) as piece, unnest(range(len(string_split(pieces, ' ')))) as i from merged)
      left join ids using (piece) group by token)"""


@query(
    "tok_bpe_pretokens",
    f"with recursive {MERGED_CTE} select token, n, pieces, ids from words join merged using (token) join numbered using (token)",
)
def tok_bpe_pretokens(spark, sf_dir):
    """Distinct pre-tokens through 50,000 byte-level merges to pieces and ids."""
    merges, vocab = read_tokenizer(spark, f"file://{TOKENIZER}")
    each = spread(documents(spark, sf_dir)).select(F.explode(tx.pretokens(F.col("text"))).alias("token"))
    words = stage(each.groupBy("token").agg(F.count("*").alias("n")).withColumn("word", mg.byte_text(F.col("token"))), "words")
    pieces = mg.bpe(words, merges)
    both = stage(words.join(pieces, "word").drop("word"), "pieces")
    lists = both.select(F.col("token").alias("word"), F.col("pieces").alias("tokens"))
    shown = both.join(vb.id_lists(lists, vocab, "word", unknown=0), F.col("token") == F.col("word"))
    return shown.select("token", "n", F.array_join("pieces", " ").alias("pieces"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "tok_byte_ids",
    f"""with recursive {MERGED_CTE},
    spots as (select doc_id, unnest(l) as token, unnest(range(len(l))) as pos from (select doc_id, {PLAIN_ORACLE} as l from documents))
    select doc_id, string_agg(ids, ' ' order by pos) || ' ' || (select max(id) + 1 from ids) as ids
    from spots join numbered using (token) group by doc_id""",
)
def tok_byte_ids(spark, sf_dir):
    """Whole documents, closed by a special token behind the vocabulary: pre-tokens, merges and ids in one pass."""
    merges, vocab = read_tokenizer(spark, f"file://{TOKENIZER}")
    tokens = F.transform(tx.pretokens(F.col("text")), mg.byte_text)
    lists = spread(documents(spark, sf_dir)).filter("text <> ''").select("doc_id", F.array_append(tokens, F.lit(END_OF_TEXT)).alias("tokens"))
    ids = mg.encode_lists(lists, "doc_id", "tokens", merges, vocab, unknown=0, specials=[END_OF_TEXT])
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "tok_paragraphs",
    f"""with lists as (select doc_id, string_split({WITH_CJK}, chr(10) || chr(10)) as l from documents),
    parts as (select doc_id, len(l) as n, unnest(range(len(l))) as para, unnest(l) as t from lists),
    ended as (select doc_id, para, t || case when para < n - 1 then chr(10) || chr(10) else '' end as t from parts)
    select doc_id, para, regexp_replace(t, '([\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3006}}\\x{{3007}}])',
      '¦\\1¦', 'g') as t from ended where t <> ''""",
)
def tok_paragraphs(spark, sf_dir):
    mixed = documents(spark, sf_dir).selectExpr("doc_id", f"{WITH_CJK} as text")
    paras = mixed.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("para", "t")).filter("t <> ''")
    return paras.select("doc_id", F.col("para").cast("bigint").alias("para"), tx.mark_ideographs(F.col("t")).alias("t"))


@query(
    "tok_paragraph_tokens",
    f"""with paras as (select doc_id, string_split({WITH_CJK}, chr(10) || chr(10)) as l from documents),
    parts as (select doc_id, len(l) as n, unnest(range(len(l))) as para, unnest(l) as t from paras),
    marked as (select doc_id, para, string_split(regexp_replace(t || case when para < n - 1 then chr(10) || chr(10) else '' end,
      '([\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3006}}\\x{{3007}}])', '¦\\1¦', 'g'), '¦') as l from parts),
    stretches as (select doc_id, para, unnest(range(len(l))) as spot, unnest(l) as text from marked),
    tokens as (select doc_id, para, spot, {PLAIN_ORACLE} as l from stretches where text <> '')
    select doc_id, cast(sum(len(l)) as bigint) as n, string_agg(array_to_string(l, '¦'), '¦' order by para, spot) as tokens from tokens group by doc_id""",
)
def tok_paragraph_tokens(spark, sf_dir):
    mixed = spread(documents(spark, sf_dir)).selectExpr("doc_id", f"{WITH_CJK} as text")
    lists = mixed.select("doc_id", tx.paragraph_tokens(F.col("text")).alias("l")).filter(F.size("l") > 0)
    return lists.select("doc_id", F.size("l").cast("bigint").alias("n"), F.array_join("l", "¦").alias("tokens"))


@query(
    "tok_detokenize",
    f"""with {VOCAB_CTE},
    ids as (select doc_id, pos, case when pos % 5 = 4 and length(token) = 1 then '##' || token
              when vocab.id is null then '[UNK]' else token end as token
            from doc_tokens left join vocab using (token)),
    joined as (select doc_id, trim(replace(string_agg(token, ' ' order by pos), ' ##', '')) as text,
        string_agg(case when token like '##%' then substr(token, 3) else ' ' || token end, '' order by pos) as plain
      from ids group by doc_id)
    select doc_id, {"replace(" * len(vb.TIDY)}text{"".join(
        f", '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in vb.TIDY
    )} as text, plain from joined""",
)
def tok_detokenize(spark, sf_dir):
    """Every fifth one-character token is turned into its inner piece, so that pieces occur."""
    vocab, lists = vocab_and_lists(spark, sf_dir)
    pieces = F.transform(
        "tokens", lambda t, i: F.when((i % 5 == 4) & (F.length(t) == 1), F.concat(F.lit("##"), t)).otherwise(t)
    )
    ids = vb.id_lists(lists.select("doc_id", pieces.alias("tokens")), vocab, "doc_id").filter(F.size("ids") > 0)
    back = vb.token_lists(ids, vocab, "doc_id")
    return back.select(
        "doc_id", vb.tokens_to_text(F.col("tokens")).alias("text"), vb.pieces_to_text(F.col("tokens")).alias("plain")
    )
