from __future__ import annotations

import os
import random

import numpy as np
import pytest

from quillwave.llm import packing, residue, tokens
from tests.conftest import DATA, rows

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files")
TEXTS = [
    None, "", " ", "\n\n", "Hello world", "it's we'll I'M don't  x", "<|endoftext|> a<|endoftext|>", "naïve café Größe", "日本語 テスト。", "ผลลัพธ์ 12", "🙂🧠‍📈", "a\xa0b​c　 end", "x² ½ Ⅷ ①a",
    "tab\t\tnewline\r\n\r\n  indented\n   \n", "\x00\x1c\x1d a\x85b", "a_b__c 1_000", "１２ ٣٤", "é é", "ab" * 20_000, " " * 5000, "­⁠", "𝔘𝔫𝔦",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "Hello world", ""), (4, "Hello world", "")], "doc_id long, text string, ids string")
    got = tokens.encode_texts(df, "doc_id", "text")
    by_id = {r.doc_id: r.ids for r in got.collect()}
    assert got.count() == len(TEXTS) + 2 and by_id[0] == by_id[1] == [] and by_id[None] == by_id[4]
    for i, t in enumerate(TEXTS):
        assert by_id[i] == reference(t), repr(t[:40] if t else t)
    back = {r.doc_id: r.text for r in tokens.decode_ids(got.where("doc_id IS NOT NULL"), "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "doc_id", "text").collect()}
    assert all(counts[i] == len(by_id[i]) for i in range(len(TEXTS)))
    assert tokens.encode_texts(df.where("false"), "doc_id", "text").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_ids_of_documents(spark, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.ids == reference(text[r.doc_id]) for r in tokens.encode_texts(docs, "doc_id", "text").collect())


def test_random_texts_equal_and_cache_is_bounded(reference):
    rng = random.Random(3)
    alphabet = "ab1 \n\t'sé_-.²日​　Ⅷ" + "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(60))
    coder = tokens.Encoder(tokens.build_model(tokens.load_ranks()), limit=50)
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(coder.encode(t), "<i4").tolist() == reference(t), repr(t)
    assert len(coder) <= 50


def check_packing(lengths, specs, found):
    for spec, capacity in specs:
        mine = [r for r in found if r.spec_id == spec]
        load, pieces = {}, {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        assert max(load.values(), default=0) <= capacity
        assert set(pieces) == {k for k, _ in lengths}
        for k, n in lengths:
            own = sorted(pieces[k])
            assert [p for p, _ in own] == list(range(len(own))) and sum(x for _, x in own) == (n or 0)
            assert len(own) == max(1, -(-(n or 0) // capacity))


def test_packing(spark):
    rng = random.Random(6)
    lengths = [(i, rng.choice([0, None, 5, 100, 512, 513, 5000, rng.randrange(1, 700)])) for i in range(800)]
    specs = [(1, 512), (2, 2048)]
    df = spark.createDataFrame([(*x, 9) for x in lengths], "doc_id long, n_tokens long, piece int")
    table = spark.createDataFrame([*specs, (3, 0), (4, None)], "spec_id int, capacity_tokens int")
    for block in (20_000, 100):
        check_packing(lengths, specs, packing.pack(df, "doc_id", "n_tokens", table, block).collect())
    assert packing.pack(df.where("false"), "doc_id", "n_tokens", table).count() == 0
    assert rows(packing.pack(df.where("doc_id = -1").union(spark.createDataFrame([(7, None, 1)], df.schema)), "doc_id", "n_tokens", table), "spec_id", "piece", "n_tokens") == [(1, 0, 0), (2, 0, 0)]


def test_repeated_and_null_keys_are_texts_of_their_own(spark):
    df = spark.createDataFrame([(4, 1500), (4, 1500), (4, 600), (None, 1500), (None, 1500), (None, 3)] + [(7, 1)] * 50, "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 512)], "spec_id int, capacity_tokens int")
    for block in (20_000, 10):
        got = packing.pack(df, "doc_id", "n_tokens", specs, block).collect()
        load = {}
        for r in got:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert max(load.values()) <= 512 and sum(load.values()) == 4 * 1500 + 600 + 3 + 50 and len(got) == 4 * 3 + 2 + 1 + 50
        assert sum(r.container.startswith("1-full") for r in got) == 9


def test_too_many_specs_are_an_error(spark):
    specs = spark.range(1001).selectExpr("int(id) AS spec_id", "512 AS capacity_tokens")
    with pytest.raises(ValueError, match="1000"):
        packing.pack(spark.createDataFrame([(1, 2)], "doc_id long, n_tokens long"), "doc_id", "n_tokens", specs)


def test_packing_is_tight():
    rng = random.Random(8)
    for capacity in (512, 2048):
        sizes = np.array(sorted((min(capacity, int(rng.lognormvariate(5.7, 0.8)) + 1) for _ in range(5000)), reverse=True))
        used = packing.pack_block(sizes, capacity).max() + 1
        least = max(-(-int(sizes.sum()) // capacity), int((sizes > capacity / 2).sum()))
        assert used <= least * 1.01 + 1


COMMIT = "commit {h}\nAuthor: Ann Example <ann@mail.example>\nDate:   2025-01-01 00:00:00 +0000\n\n    {m}\n\n{rest}"
DIFF = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n a\n+{{{{ title }}}}\n+Error 404: page not found\n"


def commit(message, rest=DIFF):
    return COMMIT.format(h="a" * 40, m=message, rest=rest)


BAD = [
    "Error 404: the requested commit could not be loaded. Request id 733a78308146.", "THIS APP ONLY WORKS WITH SCRIPTS ENABLED!", "Home > Commits\nHTTP 500\ndiff has moved or was deleted\nstatus page",
    "<!doctype html>\n<body><h1>502</h1><p>The commit was blocked by the gateway.</p></body>", "ページが見つかりません (404)", "JavaScript が無効です。有効にしてください。", "sample text sample text sample text", "Dolet adipi sitam porta sitam magnis nullam lorem.",
    commit("{{ title }}"), commit("Merge {summary} into XXXX: branch (max 57 characters)"), commit("Fix window parser", "Veuillez activer les scripts pour afficher la page.\n"), commit("blah blah blah blah blah"), commit("Fix parser\n\n    Tested: ${GROUP}"),
    commit("Fix window parser").replace("Ann Example <ann@mail.example>", "{{ author }} <${EMAIL}>"), "From " + "b" * 40 + "\nFrom: A B <a@b.c>\nDate: x\nSubject: [PATCH] Update [insert title here]\n---\n" + DIFF,
    "0123abcd Ann Example: Fix parser\n\nfoo bar baz foo bar baz foo bar baz\n", "author: Ann Example <a@b.c>\nmessage: <title goes here>\nsha: " + "c" * 40 + "\n\n" + DIFF,
]
GOOD = [
    None, "", " \r\n ", commit("Fix TODO: describe item limits properly"), commit("Stop logging 'Internal server error' for empty windows"), commit("Replace `{{ node }}` by `{{ event }}` in the header template"),
    commit("Fix parser\n\n    Users saw \"HTTP 404\" before this change."), commit("typo"), commit("Show 'Please enable JavaScript' notice in channel audit", ""), commit("Retry on 502 Bad Gateway in login form", ""), commit("Merge branch 'x' into develop", ""),
    "0123abcd build bot: Bump rate-js from 1.2.3 to 1.2.4\n", commit("Fix parser", "Binary files a/x.png and b/x.png differ\n"), "+ \t ====\n" + commit("Remove lorem ipsum from the header demo page"),
]


def test_residue(spark):
    texts = [*BAD, *GOOD]
    df = spark.createDataFrame([(i, t, "org/repo", None, 1) for i, t in enumerate(texts)] + [(0, BAD[0], None, "x", 1), (None, BAD[0], None, "x", 1)], "doc_id long, text string, source string, author_name string, flagged int")
    assert [r[0] for r in rows(residue.residue(df, "doc_id", "text", "source", "author_name"))] == list(range(len(BAD)))
    assert residue.residue(df.where("false"), "doc_id", "text", "source", "author_name").count() == 0


def test_template_with_any_label():
    bad = [
        "Ticket: $Format:%merge$(%%PROB%%): #{queue}", "Ticket: Merge <your branch> into [[author-score]]", "Ticket: Release ${LIMIT_INDEX} of [insert summary here]",
        "Ticket: [#{branch}] <!-- enter rate --> by ${ITEM_MASK}", "Ticket: {node}", "Ticket: Merge $Format:%rate$ into {limit}", "Ticket: <!-- enter frame -->(%%SIGNAL%%): {fold}",
        "Ticket: Release <%= level %> of @@FRAME@@", "Ticket: Update <window goes here>", "Owner: {name} Customer: {org}",
    ]
    good = [
        "Replace `{{ merge }}` by `{{ cutoff }}` in the header template", "Expand ${path} in paths before opening", "Fix TODO: describe item limits properly", "Use %(rate)s style in fold planner logs",
        "Fail if a {placeholder} is left in the node mail", "docs: Expand ${path}", "Quote ${VERSION}", "Ticket: none", "Update {x} and note: this changes output",
    ]
    assert [x for x in bad if not residue.judge(commit(x), "h/r").flagged] == []
    assert [x for x in good if residue.judge(commit(x), "h/r").flagged] == []


# wordings that the test tables don't have; the first four and some pages after them were known when the word lists were written, the last seven weren't
HELD_OUT = [
    "Web server is down. Error code 521. Visit the site again in a few minutes.", "You must have scripting enabled in your browser to view this page.", commit("%TITLE%: %DESCRIPTION%"), commit("asdf asdf qwer zxcv"),
    "This site can't be reached. The connection was reset.", "410 Gone", "Access to this resource on the server is denied!", commit("Fix parser", "503 Service Unavailable\nNo server is available to handle this request.\n"),
    commit("Fix parser", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.\n"), commit("[Your commit message here]"), commit("{{summary}} by {{user}}"), "Too many requests, please try again later.",
    "Unexpected error occurred while processing your request.", "We can't seem to find what you want. 404.", "Ray ID 77aa88bb: origin unreachable", "Your client does not have permission to get this URL from this server.",
    "The requested revision went missing while the mirror was rebuilt.", commit("Fix parser", "Loading viewer, hold on ...\n"), commit("Fix parser", "This space is left blank on purpose.\n"), "Robots must prove that they are none.",
]
REAL = [
    commit("no no no"), commit("bump bump bump bump"), commit("wip wip wip"), commit("Fix 404 when the page is missing"), commit("Return 503 while the queue drains"), commit("Enable JavaScript linting in CI"), commit("Handle server timeout"), commit("Remove broken link from docs"),
    commit("Support {name} placeholders in templates"), commit("Add lorem ipsum fixture for layout tests"), commit("page not found handler: log the referrer"), commit("Retry requests that timed out"), commit("Bump version to 4.0.4"), commit("Do not require scripts for the login form"),
    commit("Show an error page if the request failed"), commit("Fix parser\n\n    CI said: Error 404: page not found. Please try again later."), commit("Reload page on timeout"), commit("Update README", "diff --git a/a b/b\nsimilarity index 100%\nrename from a\nrename to b\n"),
    commit("mode only", "diff --git a/a b/a\nold mode 100644\nnew mode 100755\n"), commit("Allow cookies to be disabled"), commit("x", "diff --git a/x.png b/x.png\nindex 1..2\nGIT binary patch\nliteral 12\nTcmZQzKmaE|00000\n\n"),
]


def test_held_out_wordings(spark):
    alone = [residue.judge(x, "org/repo") for x in HELD_OUT]
    assert sum(v.flagged for v in alone) >= 0.6 * len(HELD_OUT)
    assert [x for x, v in zip(HELD_OUT, alone, strict=True) if not v.flagged and not v.weak] == []
    assert [x for x in REAL if residue.judge(x, "org/repo").flagged] == []
    # the same responses on several hosts, for several authors: host evidence decides those that the detectors know in part only
    many = [(k * 100 + i, x, f"h{k % 4}/r", f"a{k}") for i, x in enumerate(HELD_OUT) for k in range(8)] + [(10_000 + k * 100 + i, x, f"h{k % 4}/r", f"a{k}") for i, x in enumerate(REAL) for k in range(8)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string, author_name string")
    found = {r[0] for r in residue.residue(df, "doc_id", "text", "source", "author_name").collect()}
    assert found == {i for i, *_ in many if i < 10_000}


def test_changes_are_judged_too():
    shell = "diff --git a/x.py b/x.py\n"
    bad = [shell + "Error 404: the requested commit could not be loaded.\n", DIFF + shell + "HTTP 500 Internal Server Error\n", DIFF + "Sorry, this diff is not available.\n", shell + "index 1..2 100644\n{{ changes }}\n"]
    assert [x for x in bad if not residue.judge(commit("Fix window parser", x), "h/r").flagged] == []
    good = [DIFF, DIFF + "-- \n2.4\n", shell + "Binary files a/x.py and b/x.py differ\n", shell + "new file mode 100644\nindex 0..1\n", shell]
    assert [x for x in good if residue.judge(commit("Fix window parser", x), "h/r").flagged] == []


def test_terms_in_common_with_slug_and_title_are_content():
    rest = "Scheduler page timeout is not available in ward board yet."
    assert residue.judge(commit("Document scheduler page timeout of ward board", rest + "\n"), "org/ward-board").flagged is False


def test_host_evidence_decides_suspect_responses(spark):
    odd = "The commit could not be loaded. Quark"  # only partly a known page
    spread = [(i, odd, f"h{i % 4}/r", f"a{i}", 1) for i in range(8)]
    alone = [(100, "The diff could not be found. Strange", "h/r", "a", 1)]
    df = spark.createDataFrame(spread + alone, "doc_id long, text string, source string, author_name string, x int")
    assert [r[0] for r in rows(residue.residue(df, "doc_id", "text", "source", "author_name"))] == list(range(8))


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, commit("Fix parser", DIFF + "+x\n" * 400_000), "h", "a"), (2, "word " * 200_000, "h", "a")], "doc_id long, text string, source string, author_name string")
    assert [r[0] for r in rows(residue.residue(df, "doc_id", "text", "source", "author_name"))] == [2]
