"""Text analytics: token estimates, chunking, cleaning, markdown, labels, subtitles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions.captions import captions
from colloquy.functions import udfs as U
from colloquy.plans.registry import query
from colloquy.sources.tables import SEG, load, role_key, transcripts

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def docs(spark, d):
    return load(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")


@query("f3_token_estimate", "select doc_id, ceil((a * 7 + (b - a) * 8) / 20)::bigint tokens from (select doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) a, strlen(text) b from documents)")
def f3(spark, d):
    return docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("f4_boundary_chunks")
def f4(spark, d):
    """Chunks of about 400 tokens with 40 of overlap, ended at lines, sentences or words."""
    return U.boundary_chunks(docs(spark, d), "doc_id", "text", 400, 40)


@query("f5_sliding_chunks", "with g as (select doc_id, text, unnest(range(0, length(text), 900)) s from documents) select doc_id, s // 900 chunk_no, s chunk_start, substr(text, s + 1, 1000) chunk from g")
def f5(spark, d):
    c = X.sliding_chunks(docs(spark, d).select("doc_id", "text"), "text", 1000, 100)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("chunk_start").cast("long").alias("chunk_start"), "chunk")


@query("f6_chunk_size_by_model", "select doc_id, case when m like 'phi4%' or m like 'llama%' then 10000 else 30000 end::bigint size, 1000::bigint overlap from (select doc_id, (['phi4:mini','llama3','gemma','x-llama'])[doc_id % 4 + 1] m from documents)")
def f6(spark, d):
    model = F.element_at(F.array(*map(F.lit, ["phi4:mini", "llama3", "gemma", "x-llama"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.when(model.startswith("phi4") | model.startswith("llama"), 10000).otherwise(30000).cast("long").alias("size"), F.lit(1000).cast("long").alias("overlap"))


@query("f7_budget_groups", f"""with recursive {SEG}, n as (select meeting_id, seq, row_number() over (partition by meeting_id order by seq) i, ceil((length(regexp_replace(transcript, '[^\\x00-\\x7F]', '', 'g')) * 7 + (strlen(transcript) - length(regexp_replace(transcript, '[^\\x00-\\x7F]', '', 'g'))) * 8) / 20)::bigint tokens from seg),
g as (select meeting_id, seq, i, tokens, tokens used, 0 grp from n where i = 1
      union all select n.meeting_id, n.seq, n.i, n.tokens, case when g.used + 2 + n.tokens <= 300 then g.used + 2 + n.tokens else n.tokens end, case when g.used + 2 + n.tokens <= 300 then g.grp else g.grp + 1 end from g join n on n.meeting_id = g.meeting_id and n.i = g.i + 1)
select meeting_id, seq, tokens, grp::int grp from g""")
def f7(spark, d):
    """Ordered segments of each meeting in groups whose joined estimate stays within 300 tokens."""
    t = transcripts(spark, d).select("meeting_id", "seq", X.token_estimate(F.col("transcript")).alias("tokens"))
    return U.budget_groups(t, "meeting_id", "seq", "tokens", budget=300, separator=2)


@query("f8_pairwise_groups", f"with {SEG}, n as (select meeting_id, seq, row_number() over (partition by meeting_id order by seq) - 1 pos from seg) select meeting_id, pos // 2 grp, min(pos) first_pos, max(pos) + 1 end_pos from n group by 1, 2")
def f8(spark, d):
    pos = F.row_number().over(Window.partitionBy("meeting_id").orderBy("seq")).cast("long") - 1
    n = transcripts(spark, d).select("meeting_id", pos.alias("pos"))
    return n.groupBy("meeting_id", F.floor(F.col("pos") / 2).alias("grp")).agg(F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"))


@query("f9_tree_reduce", f"with {SEG}, w as (select meeting_id, seq, split_part(transcript, ' ', 1) first_word from seg) select meeting_id, string_agg(first_word, '|' order by seq) summary from w group by 1")
def f9(spark, d):
    """Summaries joined pair by pair until each meeting has one; the model's part is a stub that takes the first word."""
    t = transcripts(spark, d).select("meeting_id", "seq", F.substring_index("transcript", " ", 1).alias("summary"))
    return U.tree_reduce(t, "meeting_id", "seq", "summary", "|")


@query("f10_content_budget", "select o_orderkey, greatest(256, c - least(4096, c // 4) - v - 64)::bigint budget from (select o_orderkey, (o_orderkey % 40000)::bigint c, (o_custkey % 900)::bigint v from orders)")
def f10(spark, d):
    return load(spark, d, "orders").select("o_orderkey", X.content_budget((F.col("o_orderkey") % 40000).cast("long"), (F.col("o_custkey") % 900).cast("long")).alias("budget"))


WRAPPED = "w as (select doc_id, case doc_id % 4 when 0 then '<think>secret' || chr(10) || 'x</THINK> ' || text when 1 then '```markdown' || chr(10) || replace(text, '`', '') || chr(10) || '```' when 2 then '# # Title ' || doc_id || chr(10) || text else text || '<think> open' end t from documents)"


def wrapped(spark, d):
    head, k = F.col("text"), F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.lit("<think>secret\nx</THINK> "), head)).when(k == 1, F.concat(F.lit("```markdown\n"), F.replace(head, F.lit("`"), F.lit("")), F.lit("\n```")))
    t = t.when(k == 2, F.concat(F.lit("# # Title "), "doc_id", F.lit("\n"), head)).otherwise(F.concat(head, F.lit("<think> open")))
    return docs(spark, d).select("doc_id", t.alias("t"))


@query("f11_strip_reasoning", f"with {WRAPPED}, s as (select doc_id, trim(regexp_replace(t, '<think(?:ing)?>.*?</think(?:ing)?>', '', 'gis')) p from w) select doc_id, case when regexp_matches(p, '^```(?:markdown|md)?\\n.*\\n```$', 's') then trim(regexp_extract(p, '^```(?:markdown|md)?\\n(.*)\\n```$', 1, 's')) else p end clean from s")
def f11(spark, d):
    return wrapped(spark, d).select("doc_id", X.strip_reasoning(F.col("t")).alias("clean"))


@query("f12_reasoning_marker", f"with {WRAPPED} select doc_id, regexp_matches(t, '</?think(?:ing)?\\b', 'i') marked from w")
def f12(spark, d):
    return wrapped(spark, d).select("doc_id", X.has_reasoning_marker(F.col("t")).alias("marked"))


@query("f13_first_heading", f"with {WRAPPED} select doc_id, case when doc_id % 4 = 2 then 'Title ' || doc_id end title from w")
def f13(spark, d):
    return wrapped(spark, d).select("doc_id", X.first_heading(F.col("t")).alias("title"))


@query("f14_strip_heading", f"with {WRAPPED} select doc_id, case when starts_with(t, '# ') then ltrim(regexp_replace(t, '^# [^\\n]*\\n?', '')) else t end body from w")
def f14(spark, d):
    return wrapped(spark, d).select("doc_id", X.strip_first_heading(F.col("t")).alias("body"))


@query("f15_fingerprint", "select doc_id, lpad(lower(hex(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::hugeint), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::hugeint)::ubigint)), 16, '0') || ':' || strlen(text) fingerprint from documents")
def f15(spark, d):
    return docs(spark, d).select("doc_id", U.fnv1a(F.col("text")).alias("fingerprint"))


@query("f16_cache_hit", "select a.doc_id, a.lang <> 'en' and b.lang is distinct from a.lang hit from documents a join documents b on b.doc_id = a.doc_id + 1 and (a.n_chars % 10) is not distinct from (b.n_chars % 10)")
def f16(spark, d):
    a = docs(spark, d).select("doc_id", "lang", F.struct((F.col("n_chars") % 10).alias("n")).alias("source"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("cached_lang"), F.col("source").alias("cached_source"))
    same = a.join(b, "doc_id").where(F.col("source").eqNullSafe(F.col("cached_source")))
    return same.select("doc_id", ((F.col("lang") != "en") & ~F.col("cached_lang").eqNullSafe(F.col("lang"))).alias("hit"))


TEMPLATE = "t as (select o_custkey, o_orderkey, 'Part ' || o_orderkey title, case o_orderkey % 3 when 0 then 'paragraph' when 1 then 'list' else 'table' end fmt from orders)"


def template_sections(spark, d):
    o = load(spark, d, "orders")
    fmt = F.when(F.col("o_orderkey") % 3 == 0, "paragraph").when(F.col("o_orderkey") % 3 == 1, "list").otherwise("table")
    return o.select("o_custkey", "o_orderkey", F.concat(F.lit("Part "), "o_orderkey").alias("title"), fmt.alias("fmt"))


@query("f17_template_markdown", f"with {TEMPLATE} select o_custkey, '# Notes' || chr(10) || string_agg('**' || title || '**', chr(10) order by o_orderkey) markdown from t group by 1")
def f17(spark, d):
    s = template_sections(spark, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "title"))).alias("s"))
    return s.select("o_custkey", F.concat(F.lit("# Notes\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("**"), x["title"], F.lit("**"))), "\n")).alias("markdown"))


@query("f17_instructions", f"""with {TEMPLATE}, s as (select *, case when o_orderkey % 2 = 0 then '| ' || title || ' |' end form, case when o_orderkey % 5 = 0 then '- ' || fmt end example from t)
select o_custkey, '# <Add Title here>' || chr(10) || chr(10) || string_agg('**' || title || '**' || chr(10) || chr(10), '' order by o_orderkey) markdown,
       '- **For the main title (`# [AI-Generated Title]`):** Analyze the entire transcript and create a concise, descriptive title for the meeting.' || chr(10) || string_agg('- **For the ' || chr(39) || title || chr(39) || ' section:** Write a ' || fmt || '.' || chr(10)
       || coalesce('  - Items in this section should follow the format: `' || coalesce(form, example) || '`.' || chr(10), ''), '' order by o_orderkey) instructions from s group by 1""")
def f17b(spark, d):
    """The empty summary of each customer's template, and what a model is told of its sections."""
    form, example = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("| "), "title", F.lit(" |"))), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("- "), "fmt"))
    section = F.struct("o_orderkey", "title", F.concat(F.lit("Write a "), "fmt").alias("instruction"), form.alias("item_format"), example.alias("example_item_format"))
    sections = template_sections(spark, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list(section)).alias("s"))
    return sections.select("o_custkey", X.template_markdown(F.col("s")).alias("markdown"), X.template_instructions(F.col("s")).alias("instructions"))


@query("f18_template_errors", f"with {TEMPLATE} select o_custkey, min_by(case when fmt not in ('paragraph','list','string') then 'bad format in ' || title end, o_orderkey) filter (fmt not in ('paragraph','list','string')) error from t group by 1")
def f18(spark, d):
    bad = F.when(~F.col("fmt").isin("paragraph", "list", "string"), F.concat(F.lit("bad format in "), "title"))
    return template_sections(spark, d).groupBy("o_custkey").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("o_orderkey"))).alias("error"))


CODES = "c as (select o_orderkey, (['en','DE','pt_BR','zh-TW','zh_cn','xx','fr-CA',' it '])[o_orderkey % 8 + 1] code from orders)"


def codes(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ["en", "DE", "pt_BR", "zh-TW", "zh_cn", "xx", "fr-CA", " it "])), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("code"))


@query("f19_language_name", f"with {CODES} select o_orderkey, case code when 'en' then 'English' when 'DE' then 'German' when 'pt_BR' then 'Portuguese' when 'zh-TW' then 'Traditional Chinese' when 'zh_cn' then 'Chinese' when 'fr-CA' then 'French' when ' it ' then 'Italian' end as name from c")
def f19(spark, d):
    return codes(spark, d).select("o_orderkey", X.language_name(F.col("code")).alias("name"))


@query("f20_language_code", f"with {CODES} select o_orderkey, case code when 'en' then 'en' when 'DE' then 'de' when 'pt_BR' then 'pt' when 'zh-TW' then 'zh-tw' when 'zh_cn' then 'zh' when 'fr-CA' then 'fr' when ' it ' then 'it' end code from c")
def f20(spark, d):
    return codes(spark, d).select("o_orderkey", X.language_code(F.col("code")).alias("code"))


@query("f21_language_action", "select doc_id, case when doc_id % 3 = 0 or doc_id % 3 = 1 then case when lang = 'en' then 'ReturnEnglish' else 'Normalize' end else 'Translate' end action from documents")
def f21(spark, d):
    target = F.when(F.col("doc_id") % 3 == 1, "en").when(F.col("doc_id") % 3 == 2, "de")
    return docs(spark, d).select("doc_id", X.final_action(F.col("lang"), target).alias("action"))


@query("f22_letters", "select doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) n_letters from documents")
def f22(spark, d):
    return docs(spark, d).select("doc_id", X.letters(F.col("text")).alias("n_letters"))


@query("a11_language_vote", "with v as (select conv_id % 20 g, lang, sum(w)::bigint weight from (select doc_id % 500 conv_id, lang, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) w from documents) where w >= 20 group by 1, 2), m as (select g, max(weight) top from v group by 1) select m.g, case when count(*) = 1 then min(v.lang) end lang, m.top from m join v on v.g = m.g and v.weight = m.top group by m.g, m.top")
def a11(spark, d):
    """The language with most letters; a tie has none."""
    w = docs(spark, d).select((F.col("doc_id") % 500 % 20).alias("g"), "lang", X.letters(F.col("text")).alias("w")).where("w >= 20")
    v = w.groupBy("g", "lang").agg(F.sum("w").alias("weight"))
    r = v.withColumn("top", F.max("weight").over(Window.partitionBy("g"))).where("weight = top")
    return r.groupBy("g", "top").agg(F.when(F.count("*") == 1, F.min("lang")).alias("lang")).select("g", "lang", "top")


TOKENS = f"k as (select doc_id, list_transform({WORDS}, lambda w: lower(w)) w from documents)"


@query("f23_collapse_repeats", f"with k as (select doc_id, {WORDS} w from documents) select doc_id, len(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1])) n_kept, array_to_string(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), ' ') collapsed from k")
def f23(spark, d):
    k = docs(spark, d).select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", X.collapse_repeats(F.col("w")).alias("c"))
    return k.select("doc_id", F.size("c").cast("long").alias("n_kept"), F.array_join("c", " ").alias("collapsed"))


@query("f24_f26_clean_transcript")
def f26(spark, d):
    return docs(spark, d).select("doc_id", X.clean_repetitive(F.col("text")).alias("cleaned"))


@query("a17_repetition_ratio", f"with {TOKENS} select doc_id, case when len(w) < 4 then 0 else round((len(w) - len(list_distinct(w))) / len(w), 6) end::double ratio from k")
def a17(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.repetition_ratio(F.col("text")), 6).alias("ratio"))


@query("f25_meaningless", "select doc_id, regexp_matches(lower(text), 'thank you for watching|thanks for watching|like and subscribe|music playing|applause|laughter|um um um|uh uh uh|ah ah ah') or (len(list_distinct(string_split(text, ''))) <= 3 and strlen(text) > 10) meaningless from documents")
def f25(spark, d):
    return docs(spark, d).select("doc_id", X.is_meaningless(F.col("text")).alias("meaningless"))


@query("f27_f32_post_process")
def f32(spark, d):
    """The background cleaner: phrase repeats, fillers, punctuation, contractions."""
    return docs(spark, d).select("doc_id", X.post_process(F.col("text"), F.col("doc_id") % 5 == 0).alias("processed"))


@query("f28_drop_fillers", f"select doc_id, array_to_string(list_filter({WORDS}, lambda w: not list_contains(['uh','um','er','ah','oh','hm','hmm','uhh','umm','err','ahh','ohh'], regexp_replace(lower(w), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g'))), ' ') cleaned from documents")
def f28(spark, d):
    return docs(spark, d).select("doc_id", X.drop_fillers(F.col("text")).alias("cleaned"))


@query("f29_ui_fillers", "select doc_id, trim(regexp_replace(regexp_replace(text, '\\b(?:the|of|and)\\b[,\\s]*', ' ', 'gi'), '\\s+', ' ', 'g')) shown from documents")
def f29(spark, d):
    return docs(spark, d).select("doc_id", X.drop_fillers_ui(F.col("text"), ["the", "of", "and"]).alias("shown"))


TIDY = "replace(replace(replace(replace(trim(text), ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!')"


@query("f30_tidy", f"select doc_id, upper(left(t, 1)) || substr(t, 2) tidy from (select doc_id, replace(replace(replace({TIDY}, '.  ', '. '), '?  ', '? '), '!  ', '! ') t from documents)")
def f30(spark, d):
    return docs(spark, d).select("doc_id", X.tidy(F.col("text")).alias("tidy"))


#: Words of the texts stand for contractions without an apostrophe, so that all fifteen occur, alone and within words.
SPOKEN = [(" the ", " hasnt wouldnt "), (" of ", " cantdont "), (" and ", " doesnt arent wasnt "), (" de ", " didnt couldnt "), (" la ", " wont isnt hadnt "), (" der ", " shouldnt werent "), (" que ", " havent wasntisnt ")]


def replaced(text, pairs):
    """The SQL that replaces one text after the other."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    for old, new in pairs:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


@query("f31_contractions", f"select doc_id, {replaced(replaced('text', SPOKEN), [(w, w[:-1] + chr(39) + 't') for w in X.CONTRACTIONS])} t from documents")
def f31(spark, d):
    text = F.col("text")
    for old, new in SPOKEN:
        text = F.replace(text, F.lit(old), F.lit(new))
    return docs(spark, d).select("doc_id", X.contractions(text).alias("t"))


CLOCK = "printf('[%02d:%02d]', (start_ms // 1000) // 60, (start_ms // 1000) % 60)"


@query("f33_f34_clock", f"with {SEG} select id, case when seq % 4 = 3 then '[--:--]' else {CLOCK} end shown from seg")
def f33(spark, d):
    return transcripts(spark, d).select("id", X.clock(F.when(F.col("seq") % 4 != 3, F.col("start_ms") / 1000)).alias("shown"))


@query("f35_f37_speaker_key", "select s_suppkey, case when s_suppkey % 3 = 0 then null when s_suppkey % 12 = 0 then null else s_suppkey % 12 - 1 end::bigint idx, case when s_suppkey % 3 = 0 or s_suppkey % 12 = 0 then null else (s_suppkey % 12 - 1) % 8 end::bigint colour from supplier")
def f35(spark, d):
    key = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "X").otherwise("S"), F.col("s_suppkey") % 12)
    return load(spark, d, "supplier").select("s_suppkey", X.key_index(key).cast("long").alias("idx"), X.colour(key).cast("long").alias("colour"))


@query("f38_safe_filename", "select page_id, trim(regexp_replace(url, '[<>:\"/\\\\|?*[:cntrl:]]', '_', 'g')) as name from pages")
def f38(spark, d):
    return load(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("f39_section_keys", "with t as (select p_size % 5 g, p_partkey pos, replace(replace(lower(p_type), ' & ', '_'), ' ', '_') k from part) select g::bigint g, pos, case when row_number() over (partition by g, k order by pos) = 1 then k else k || '_' || pos end section_key from t")
def f39(spark, d):
    p = load(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("g"), F.col("p_partkey").alias("pos"), "p_type")
    return X.snake_keys(p, "g", "pos", "p_type").select("g", "pos", "section_key")


@query("f40_double_json", "select event_id, (props ->> 'k')::bigint k from events")
def f40(spark, d):
    """JSON in a JSON string, read twice."""
    twice = F.to_json(F.struct(F.col("props").alias("r")))
    return load(spark, d, "events").select("event_id", F.from_json(F.from_json(twice, "r string")["r"], "k bigint")["k"].alias("k"))


@query("p13_f41_f42_blocks", "with t as (select doc_id, case when doc_id % 3 = 0 then '<think>hidden' else text end t from documents), m as (select *, regexp_matches(t, '</?think(?:ing)?\\b', 'i') marked, regexp_matches(t, '\\S') visible from t) select doc_id, visible, marked, case when marked then '' else t end redacted, visible and not marked renderable from m")
def f41(spark, d):
    """Visible text, reasoning markers and redaction in nested blocks."""
    body = F.to_json(F.struct(F.array(F.struct(F.lit("1").alias("id"), F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, "<think>hidden").otherwise(F.col("text")).alias("text"))).alias("content"), F.array().cast("array<string>").alias("children"))).alias("blocks")))
    facts = docs(spark, d).select("doc_id", U.block_facts(body).alias("f"))
    return facts.select("doc_id", "f.visible", "f.marked", F.get_json_object("f.redacted", "$.blocks[0].content[0].text").alias("redacted"), "f.renderable")


@query("f43_verbose_json", f"with {SEG} select id, start_ms / 10 * 0.01 start_s, round(-length(transcript) / greatest(seq + 1, 1)::double, 6) avg_logprob from seg")
def f43(spark, d):
    return transcripts(spark, d).select("id", (F.col("start_ms") / 10 * 0.01).alias("start_s"), F.round(-F.length("transcript") / F.greatest(F.col("seq") + 1, F.lit(1)), 6).alias("avg_logprob"))


@query("f44_join_tokens", "select doc_id, trim(regexp_replace(regexp_replace(array_to_string(string_split(text, ' '), '▁'), '▁', ' ', 'g'), ' ([.,!?])', '\\1', 'g')) joined from documents")
def f44(spark, d):
    tokens = F.array_join(F.split("text", " "), "▁")
    return docs(spark, d).select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(tokens, "▁", " "), " ([.,!?])", "$1")).alias("joined"))


@query("f46_st13_adjacent_duplicates", f"with {SEG}, x as (select id, meeting_id, seq, trim(replace(transcript, '[BLANK_AUDIO]', '')) t, end_ms - start_ms dur from seg) select id from (select *, lag(md5(t)) over (partition by meeting_id order by seq) before from x where t <> '' and dur >= 1000) where before is null or before <> md5(t)")
def f46(spark, d):
    t = transcripts(spark, d).withColumn("t", F.trim(F.replace(F.col("transcript"), F.lit("[BLANK_AUDIO]"), F.lit("")))).where("t != '' and end_ms - start_ms >= 1000")
    before = F.lag(F.md5("t")).over(Window.partitionBy("meeting_id").orderBy("seq"))
    return t.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.md5("t"))).select("id")


@query("k17_srt", f"""with {SEG}, n as (select *, row_number() over (partition by meeting_id order by seq) i from seg),
l as (select meeting_id, i, i || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, end_ms % 1000) || chr(10) || transcript line from n)
select meeting_id, string_agg(line, chr(10) || chr(10) order by i) srt from l group by 1""")
def k17(spark, d):
    i = F.row_number().over(Window.partitionBy("meeting_id").orderBy("seq"))
    line = F.concat_ws("\n", F.col("i").cast("string"), F.concat(X.srt_time(F.col("start_ms")), F.lit(" --> "), X.srt_time(F.col("end_ms"))), "transcript")
    lines = transcripts(spark, d).withColumn("i", i).select("meeting_id", "i", line.alias("line"))
    return U.joined_lines(lines, "meeting_id", "i", "line", "\n\n", "srt")


@query("k18_copy_markdown", f"with {SEG} select meeting_id, string_agg({CLOCK} || ' ' || case speaker when 'user' then 'Speaker 1' when 'assistant' then 'Speaker 2' else 'Speaker 3' end || ': ' || transcript || '  ', chr(10) order by seq) markdown from seg group by 1")
def k18(spark, d):
    label = X.speaker_label(F.lit(None).cast("string"), F.lit(False), role_key(F.col("speaker")))
    line = F.concat(X.clock(F.col("start_ms") / 1000), F.lit(" "), label, F.lit(": "), "transcript", F.lit("  "))
    return U.joined_lines(transcripts(spark, d).select("meeting_id", "seq", line.alias("line")), "meeting_id", "seq", "line", "\n", "markdown")


@query("k19_legacy_markdown", "select o_custkey, string_agg('- ' || o_orderpriority, chr(10) order by o_orderkey) bullets from orders group by 1")
def k19(spark, d):
    lines = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("- "), "o_orderpriority").alias("line"))
    return U.joined_lines(lines, "o_custkey", "o_orderkey", "line", "\n", "bullets")


@query("a15_section_merge", f"with {SEG}, s as (select meeting_id, speaker title, seq, seq % 2 ok, length(transcript) n from seg) select meeting_id, title, list(n order by seq) blocks, min(seq) first_seq from s group by 1, 2")
def a15(spark, d):
    t = transcripts(spark, d).groupBy("meeting_id", F.col("speaker").alias("title")).agg(F.sort_array(F.collect_list(F.struct("seq", F.length("transcript").cast("long").alias("n")))).alias("b"), F.min("seq").alias("first_seq"))
    return t.select("meeting_id", "title", F.transform("b", lambda x: x["n"]).alias("blocks"), "first_seq")


@query("w3_speaker_headers", f"with {SEG} select id, lag(speaker) over (partition by meeting_id order by seq) is distinct from speaker header from seg")
def w3(spark, d):
    before = F.lag("speaker").over(Window.partitionBy("meeting_id").orderBy("seq"))
    return transcripts(spark, d).select("id", (~before.eqNullSafe(F.col("speaker"))).alias("header"))


@query("w4_speaker_lines", f"""with recursive {SEG}, k as (select meeting_id, seq, start_ms, case speaker when 'user' then 'S1' when 'assistant' then 'S2' else 'S3' end k, trim(transcript) t, row_number() over (partition by meeting_id order by seq) i from seg),
u as (select meeting_id, count(distinct k) > 1 useful from k group by 1),
b as (select k.*, useful, case when lag(k) over (partition by k.meeting_id order by seq) is distinct from k then 1 else 0 end b from k join u on u.meeting_id = k.meeting_id),
r as (select *, case when useful then sum(b) over (partition by meeting_id order by seq rows between unbounded preceding and current row)::bigint else seq end run from b),
f as (select meeting_id, i, run, 0::bigint part, length(t) n from r where i = 1
      union all select r.meeting_id, r.i, r.run, case when r.run <> f.run then 0 when f.n > 0 and f.n + 1 + length(r.t) > 1000 then f.part + 1 else f.part end, case when r.run <> f.run or f.n > 0 and f.n + 1 + length(r.t) > 1000 then length(r.t) else f.n + 1 + length(r.t) end from f join r on r.meeting_id = f.meeting_id and r.i = f.i + 1)
select r.meeting_id, r.run, f.part, printf('[%02d:%02d]', (min(start_ms) // 1000) // 60, (min(start_ms) // 1000) % 60) || ' ' || case when first(useful) then 'Speaker ' || substr(first(k), 2) || ': ' else '' end || string_agg(t, ' ' order by seq) line
from r join f on f.meeting_id = r.meeting_id and f.i = r.i group by r.meeting_id, r.run, f.part""")
def w4(spark, d):
    """Lines of one speaker's consecutive segments, of at most 1000 UTF-16 units."""
    t = transcripts(spark, d).select("meeting_id", "seq", "start_ms", role_key(F.col("speaker")).alias("speaker_key"), "transcript")
    return U.speaker_lines(t, cap=1000)


STAMP = "printf('%02d:%02d:%02d{m}%03d', {t} // 3600000, ({t} // 60000) % 60, ({t} // 1000) % 60, {t} % 1000)"


def spanned(mark):
    return STAMP.format(m=mark, t="start_ms") + " || ' --> ' || " + STAMP.format(m=mark, t="end_ms") + " || chr(10)"


@query("k17_captions", f"""with {SEG}, n as (select *, row_number() over (partition by meeting_id order by seq) i from seg)
select meeting_id, string_agg(i || chr(10) || {spanned(',')} || speaker || ': ' || transcript || chr(10) || chr(10), '' order by i) srt, 'WEBVTT' || chr(10) || chr(10) || string_agg({spanned('.')} || '<v ' || speaker || '>' || transcript || chr(10) || chr(10), '' order by i) vtt,
       string_agg(speaker || ': ' || transcript || chr(10), '' order by i) "plain", to_json({{'text': string_agg(speaker || ': ' || transcript || chr(10), '' order by i)}})::varchar "json",
       to_json({{'task': 'transcribe', 'language': 'en', 'duration': max(end_ms) / 1000, 'text': string_agg(speaker || ': ' || transcript || chr(10), '' order by i), 'segments': list({{'id': i - 1, 'text': transcript, 'start': start_ms / 1000, 'end': end_ms / 1000}} order by i)}})::varchar verbose_json from n group by meeting_id""")
def k17b(spark, d):
    """Each meeting as subtitles, as plain text, and as JSON with and without times."""
    return captions(transcripts(spark, d), speaker="speaker")
