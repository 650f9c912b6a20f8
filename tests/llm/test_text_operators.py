"""Extraction, formatting and encoding against plain versions."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.llm import bpe, chat_format
from terrane.llm.html_extract import extract, extract_main_text

ARTICLE = "<h1>A title</h1><p>First   paragraph, with some words.<br>And a second line; it goes on.</p><p>Short.</p><ul><li>one &amp; only</li></ul><p>Last paragraph of the text, long enough to count.</p>"
TEXT = "A title\nFirst paragraph, with some words. And a second line; it goes on.\nShort.\none & only\nLast paragraph of the text, long enough to count."
AROUND = [
    ("<nav><ul><li><a href='/'>home</a></li></ul></nav>", "<footer>&copy; someone, all rights reserved.</footer>"),
    ("<header><h2>Site name</h2></header><script>var t='</p>';</script>", "<aside>Other things, of note.</aside>"),
    ("<div class='ad'>Buy now, it is cheap, really.</div><style>p{}</style>", "<section id='comments'><p>I think, that this is, well, a comment.</p></section>"),
    ("<div class=\"cookie-notice\">We use cookies, as you know.</div>", "<form><p>Sign up, here, now.</p><input></form>"),
    ("<!-- <p>hidden, in a comment</p> --><div role='navigation'><a>x</a></div>", "<div class='sidebar-widget'><p>Popular, today.</p></div>"),
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("tag", ["article", "main", "div class='content'", "div"])
def test_article_without_its_surroundings(around, tag):
    page = f"<html><head><title>t</title></head><body>{around[0]}<{tag}>{ARTICLE}</{tag.split()[0]}>{around[1]}</body></html>"
    assert extract(page) == TEXT


def test_comments_inside_the_article_and_broken_markup():
    inside = ARTICLE + "<div class='comments'><p>A reader, with an opinion, of course.</p></div>"
    assert extract(f"<body><article>{inside}</article></body>") == TEXT
    assert extract("<p>One<p>Two <b>bold<p>Three &lt;x&gt; &#233;") == "One\nTwo bold\nThree <x> é"
    assert extract("just text,  without markup") == "just text, without markup"
    assert extract("") == "" and extract(None) == "" and extract("<nav>only a menu</nav>") == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ap div='\"!-&;x\n", max_size=200))
def test_no_markup_breaks_extraction(page):
    extract(page)


def test_no_selected_prose_is_dropped():
    long, short = "Some words, and more of them. " * 40, "A last part, shorter than the first. " * 3
    parts = [" ".join(x.split()) for x in (long, short)]
    assert extract(f"<body><div><p>{long}</p></div><div><p>{short}</p></div></body>") == "\n".join(parts)
    assert extract(f"<body><article><p>{long}</p></article><article><p>{short}</p></article></body>") == "\n".join(parts)
    page = f"<body><nav><h2>Menu</h2></nav><h1>The title</h1><div><p>{long}</p><p>{short}</p></div><footer>end</footer></body>"
    assert extract(page) == "\n".join(["The title", *parts])


def test_extraction_query(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, 7), (None, None, None, 7), (1, "u", ARTICLE, 7)], "page_id bigint, url string, html string, text int")
    out = extract_main_text(df).collect()
    assert [tuple(r) for r in out] == [(1, "u", TEXT, len(TEXT)), (None, None, "", 0), (1, "u", TEXT, len(TEXT))]
    assert extract_main_text(df.limit(0)).count() == 0
    long = extract("<article>" + "<p>Some words, here.</p>" * 20000 + "</article>")
    assert long.count("\n") == 19999


# Chat formatting.

PIECES = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "\\", "<", "|im_end|>", "\n", "a", "<<SYS>>", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "odd\nrole%0A", "<|im_end|>"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6))
def test_format_is_reversible(turns):
    formatted = chat_format.chatml(turns)
    assert [(r, t) for r, t, _, _ in chat_format.read_chatml(formatted)] == turns
    for _, text in turns:
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)


def test_spans_and_rewrites():
    state = chat_format.Incremental(chat_format.chatml)
    for turn in [("user", "a"), ("assistant", "b"), ("user", "c")]:
        state.push(*turn)
    assert not state.rewrites and state.spans[0][0] == 0 and state.spans[-1][1] == len(state.formatted)
    assert "".join(state.formatted[a:b] for a, b in state.spans) == state.formatted

    def last_only(turns):  # drops all but the last two turns: history changes
        return "".join(f"{r}:{t};" for r, t in turns[-2:])

    state = chat_format.Incremental(last_only)
    for i in range(3):
        state.push("user", str(i))
    assert state.rewrites == [(2, 5)] and state.spans[0] is None


def test_chat_query_on_a_whole_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").write.parquet(str(tmp_path / "conversations.parquet"))
    odd = spark.createDataFrame([(None, 1, "user", "x"), (99_999, 2, "assistant", None), (99_999, 1, "us%0Aer\n", "[INST] <\\s> </s>"), (99_998, 1, None, "<|im_end|>")], "conv_id bigint, turn int, role string, text string")
    table = spark.read.parquet(str(tmp_path / "conversations.parquet")).select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(odd)
    table.write.parquet(str(tmp_path / "all" / "conversations.parquet"))
    chats = collections.defaultdict(list)
    for r in table.collect():
        chats[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    chats[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in chat_format.op4_chat_format(spark, str(tmp_path / "all")).collect()}
    assert got.keys() == chats.keys() and len(chats) > 20
    for conv, turns in chats.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.rewrites_history) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
        assert r.formatted_chars == len(chat_format.chatml([(role, text) for _, role, text in turns]))


def test_chat_query(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "user", None), (2, 0, "user", None), (None, 0, None, "x"), (3, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat_format.format_chats(df).mapInArrow(chat_format._digests, chat_format.DIGEST_DDL).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and out[1].loss_sha256 == sha(said) and out[1].loss_chars == len(said)
    assert out[2].n_turns == 2 and out[2].loss_chars == 0 and out[2].loss_sha256 == sha("")
    assert out[None].turns_sha256 == sha("\nx\n") and out[3].loss_chars == 25000 and not out[3].rewrites_history
    assert chat_format.format_chats(df.limit(0)).count() == 0


# Encoding.


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def check(library, texts):
    import numpy as np

    tokens, counts = bpe.Encoder(bpe.default_vocabulary()).encode(texts)
    mine = [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])]
    assert mine == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_split_alike(library):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    check(library, [f"a{c}b 1{c}2 .{c}. {c}\n{c}{c}" for c in points])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aabetrsonil AÉ'sd \n\t0129.,!|日<|endoftext|>\x00\x1c", max_size=80), min_size=1, max_size=5))
def test_random_texts(library, texts):
    check(library, texts)


def test_hard_texts(library):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    check(library, ["a" * 5000, " " * 3000, "", "<|endoftext|>x<|endoftext|>", "\0<|endoftext|>", " ".join(words), "\n\n  \n a", "ééé" * 400])


def test_spines_agree_with_plain_merging():
    v = bpe.vocabulary(bpe.default_vocabulary())
    rnd = random.Random(7)
    ids = list(v.ids.values())
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        if v.whole(a) and v.whole(b):
            assert v._apart_by_spines(a, b) == v._apart_by_merging(a, b)


def test_encoding_query(spark, library):
    texts = ["Hello world, hello.", None, "", "x " * 30000, "é<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "n", "c"), (0, texts[0], "c")], "doc_id bigint, text string, ids string")
    out = bpe.digests(df, bpe.default_vocabulary()).collect()
    for r in [r for r in out if r.doc_id is not None]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(out) == 7 and bpe.digests(df.limit(0), bpe.default_vocabulary()).count() == 0
