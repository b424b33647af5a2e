import binascii
import hashlib
import json
import math
import random
import re
import struct
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from simlake.llm import html_extract, licenses, media, pii, toxicity


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice"><p>We use cookies</p></div>
<article><header><h1>Head&nbsp;line {0}</h1></header><p>First <b>bold<br>line</p><p>A &lt;b&gt; &amp; c
  d<div class="share-buttons">share</div><div>inner {0}</div><ul><li>one<li>two</ul><form>sign up</form></article>
<section id="comments"><p>great</p></section><aside>side</aside><footer>&copy;</footer></body></html>"""


def text_of(html):
    blocks, _ = html_extract.parse(html)
    inside = [t for t, i in blocks if i]
    return inside or [t for t, _ in blocks]


def test_structure():
    assert text_of(PAGE.format(1)) == ["Head line 1", "First bold line", "A <b> & c d", "inner 1", "one", "two"]
    assert text_of("") == [] and text_of("plain &amp; text") == ["plain & text"] and text_of("<p>a<p>b</div>c") == ["a", "b", "c"]
    assert text_of("<body><p>x</p><div hidden>no</div><script>if (a<b) {}") == ["x"]


def test_site_templates_are_removed_and_copies_kept(spark):
    rows = []
    for i in range(60):
        body = "same story" if i < 20 else f"story {i}"
        rows.append((i, f"https://h{i % 2}.example.com/{i}", f"<html><body><div>Top of the site</div><div><p>{body}</p><p>shared paragraph</p></div></body></html>"))
    rows += [(100, None, None), (101, None, ""), (100, None, "<p>again</p>"), (None, "no url", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 64
    by = {r["url"]: r["text"] for r in got if r["url"] and r["url"].startswith("http")}
    assert by["https://h1.example.com/41"] == "story 41\n\nshared paragraph" and by["https://h0.example.com/0"] == "same story\n\nshared paragraph"
    assert sorted(r["text"] for r in got if r["url"] is None) == ["", "", "again"] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<body class="has-sidebar"><p>kept</p></body>', ["kept"]),
        ('<body class="nav-open"><div class="page-wrap"><p>kept</p></div></body>', ["kept"]),
        ('<article class="post comments-open"><p>kept</p></article>', ["kept"]),
        ('<article class="story-share-enabled"><p class="notice">kept</p><h2 id="menu">too</h2></article>', ["kept", "too"]),
        ('<div class="content with-sidebar">kept</div><div class="site-sidebar">out</div><div id="mainNav">out</div><ul class="share-buttons"><li>out</li></ul>', ["kept"]),
        ('<p title="5" tall">a</p><p data-x=it\'s>b</p><p a = \'>\'>c</p>', ["a", "b", "c"]),
        ("1 < 2 and <b>bold</b> <unclosed", ["1 < 2 and bold <unclosed"]),
        ('<p>x <a href="open>y</a> z', ["x y z"]),
        ("<p>a<!-- <p>no</p> -->b<!doctype x><?php no ?>c", ["abc"]),
    ],
)
def test_broken_and_named_pages(html, want):
    assert text_of(html) == want


def test_reading_is_linear():
    for page in ('<a "' * 25_000, "<div><p>" * 12_000, '<a b="' * 20_000 + '"', "<b>" * 20_000 + "</i>" * 20_000 + "<div></div>" * 20_000, "<p>word " * 50_000):
        start = time.process_time()
        html_extract.parse(page)
        assert time.process_time() - start < 2


class _Tree(HTMLParser):
    """Well-formed pages as nested lists [tag, attributes, children]."""

    def __init__(self, html):
        super().__init__()
        self.stack = [["", {}, []]]
        self.feed(html)
        self.root = self.stack[0]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def _template_pages(rng):
    """Pages of three hosts: blocks that recur on some of them, in and outside of articles."""
    pages = []
    for i in range(150):
        host = rng.choice(["a", "a", "a", "b", "c"])
        common = [f"<div><p>box {k} of {host}</p><ul><li>one</li><li>{k}</li></ul></div>" for k in range(8) if rng.random() < k / 8]
        own = [f"<p>story {rng.randint(0, 120)}</p>" for _ in range(rng.randint(1, 2))] + ["<blockquote>said often</blockquote>"]
        main = "".join(rng.sample(common + own, len(common + own)))
        pages.append((i, f"https://{host}.example/{i}", f"<html><body>{main}</body></html>" if rng.random() < 0.5 else f"<html><body><div>around</div><article>{main}</article></body></html>"))
    return pages


def test_templates_equal_brute_force(spark, monkeypatch):
    for name, value in (("PAGES", 4), ("ARTICLE_PAGES", 9), ("TEXT_PAGES", 30)):
        monkeypatch.setattr(html_extract, name, value)
    pages = _template_pages(random.Random(2))
    texts, kinds = {"p", "blockquote"}, Counter()

    def blocks(node, around, inside):
        """(text, subtrees around it as written, whether in the article)"""
        tag, _, children = node
        if tag not in ("", "html", "body", "article") and not (inside and tag in texts):
            around = [*around, (json.dumps(node), "inside" if inside else "text" if tag in texts else "outside")]
        for c in children:
            if isinstance(c, str):
                yield c, around, inside
            else:
                yield from blocks(c, around, inside or tag == "article" or c[0] == "article")

    parsed = {}
    for i, url, html in pages:
        found = list(blocks(_Tree(html).root, [], False))
        parsed[i] = (url.split("/")[2], [b for b in found if b[2]] or found)
    seen = {(host, s, tuple(t for t, _, _ in found)) for host, found in parsed.values() for _, around, _ in found for s in around}
    counts = Counter((host, s) for host, s, _ in seen)
    least = {"outside": 4, "inside": 9, "text": 30}
    want = {i: "\n\n".join(t for t, around, _ in found if not any(counts[host, s] >= least[s[1]] for s in around)) for i, (host, found) in parsed.items()}
    for (_, (_, kind)), c in counts.items():
        kinds[kind, c >= least[kind]] += 1
    assert all(kinds[k, yes] for k in least for yes in (True, False))
    rows = [(*p, "x", "y") for p in pages]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, key string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and {r["page_id"]: r["text"] for r in got.collect()} == want


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i} &amp; more</p>" for i in range(60_000)) + "</article>"
    got = html_extract.extract(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id bigint, url string, html string")).collect()
    assert [r["n_chars"] for r in got] == [len("\n\n".join(f"line {i} & more" for i in range(60_000)))] * 2


# --- personal data ---


def test_feistel_is_a_permutation():
    f = pii.Feistel("k")
    for n in (1, 2, 3, 10, 97, 1000):
        image = [f.permute("x", n, i) for i in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute("x", n, y, sign=-1) for y in image] == list(range(n))


def test_formats_links_and_inversion():
    p, q = pii.Pseudonyms("k"), pii.Pseudonyms("k", -1)
    text = "a.b7@x.example.com 4041894974608795 4041-8949-7460-8795 +1 (988) 555-2485 988-555-2485 17.252.227.210 1984-02-29 29/02/1984 DE89 3704 0044 0532 0130 00 123-45-6789"
    new, kinds = p.apply(text)
    assert len(kinds) == 10 and q.apply(new)[0] == text
    words = new.split()
    assert words[1] == words[2].replace("-", "") and pii.luhn_digit(words[1][:-1]) == int(words[1][-1])
    assert re.sub(r"\D", "", " ".join(words[3:6]))[-10:] == words[6].replace("-", "")
    assert pii._iban_rest("".join(words[10:16])) == 1
    for clean in ("4041894974608796", "999.1.1.1", "2023-02-30", "v1.2.3.4.5", "000-12-3456", "no 12 2.0. 19", "DE00 3704 0044 0532 0130 00"):
        assert p.apply(clean) == (clean, []), clean
    assert pii.Pseudonyms("other").apply(text)[0] != new


MORE = [
    ("write to ann.lee@mail.corp-x.co.uk or bob@mail.corp-x.co.uk", ["ann.lee", "corp-x"], ["email", "email"]),
    ("host 2001:db8:85a3:0:0:8a2e:370:7334 and 2001:DB8:85A3::8A2E:370:7334", ["85a3", "8A2E"], ["ipv6", "ipv6"]),
    ("call +49 30 901820 or +44 20 7946 0958 or 020 7946 0958 today", ["901820", "7946"], ["phone", "phone", "phone"]),
    ("SSN: 536221234 is hers", ["536221234"], ["ssn"]),
    ("export T=ghp_" + "a1B2" * 9 + " K=sk-" + "Q7w8" * 6 + " S=xoxb-12345-abcDEF6789", ["a1B2", "Q7w8", "12345"], ["secret"] * 3),
]


@pytest.mark.parametrize(("text", "gone", "kinds"), MORE)
def test_more_formats(text, gone, kinds):
    for key in ("k", "another", "third"):
        new, found = pii.Pseudonyms(key).apply(text)
        assert found == kinds and not any(g in new for g in gone) and len(new) == len(text)
        assert pii.Pseudonyms(key, -1).apply(new)[0] == text
    assert [c.isdigit() for c in new if c in ":. "] == [c.isdigit() for c in text if c in ":. "]


def test_links_of_more_formats():
    p = pii.Pseudonyms("k")
    a, b = (re.sub(r"\D", "", x)[-10:] for x in p.apply("+44 20 7946 0958 / 020 7946 0958")[0].split("/"))
    assert a == b != "2079460958"
    x, y = p.apply("ann@corp.example.org bob@corp.example.org")[0].split()
    assert x.split("@")[1] == y.split("@")[1] and x.endswith(".org")
    for clean in ("std::vector and a::b", "12:30:45", "chapter 10 2 3", "+1 more", "0123 4567", "dead:beef", "sk-short", "1.2.3"):
        assert p.apply(clean) == (clean, []), clean


def test_no_valid_value_is_left(spark):
    """A scan of its own, written without the operator's patterns, finds none of the values that were in the texts."""
    rng = random.Random(77)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(body):
        for d in "0123456789":
            total = 0
            for i, c in enumerate(reversed(body + d)):
                x = int(c) * (1 + i % 2)
                total += x - 9 * (x > 9)
            if total % 10 == 0:
                return body + d

    rows, values = [], []
    for i in range(150):
        made = {
            "card": luhn("4" + digits(14)), "mail": f"u{digits(4)}@host{digits(2)}.example.com", "ip": ".".join(str(rng.randint(1, 254)) for _ in range(4)), "day": f"{rng.randint(1950, 2049)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            "phone": f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", "ssn": f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        }
        order = rng.sample(sorted(made), len(made))
        rows.append((i, " ".join(f"{rng.choice(['see', 'my', 'the'])} {made[k]}," for k in order)))
        values.append(made)
    done = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for (i, _), made in zip(rows, values, strict=True):
        new = done[i]["text"]
        assert len(done[i]["_pii_kinds"]) == 6 and not [v for v in made.values() if v in new]
        words = [w.strip(",") for w in new.split()]
        cards = [w for w in words if w.isdigit() and len(w) == 16]
        assert len(cards) == 1 and luhn(cards[0][:-1]) == cards[0]
        assert sum(w.count(".") == 3 and all(x.isdigit() and int(x) < 256 for x in w.split(".")) for w in words) == 1


def test_pii_of_odd_rows(spark, odd_docs, no_docs):
    done = pii.pseudonymise(odd_docs)
    assert done.columns == [*odd_docs.columns, "_pii_kinds"]
    key = lambda r: str(r.asDict())
    assert sorted(map(key, done.drop("_pii_kinds").collect())) == sorted(map(key, odd_docs.collect()))
    assert pii.pseudonymise(no_docs).count() == 0


# --- toxicity ---


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ten", "sor", "pa"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["idiot", "moron", "stupid", "loser"]
    texts, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.choice([8, 60, 300]))]
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return toxicity.train(texts, labels), words, rng


def test_scores_and_unseen_spellings(model):
    fitted, words, rng = model
    scorer = toxicity.Scorer(fitted)
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    clean = [scorer.score(" ".join(plain(rng.choice([8, 60, 300])))) for _ in range(100)]
    toxic = [scorer.score(" ".join([*plain(100), w, *plain(100)])) for w in ["idiot", "moron", "stupid", "loser"] * 25]
    assert sum(x < 0.3 for x in clean) >= 80 and sum(x >= 0.3 for x in toxic) >= 90
    # spellings never seen share their pieces
    assert min(scorer.score(" ".join([*plain(4), w, *plain(4)])) for w in ("IDIOTS", "stupidd", "moronn", "losers")) > sorted(clean)[50]
    assert scorer.score(None) == scorer.score(" .!? ") == 0.0


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (7, 1, 0), (8, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.scored(odd_docs, toxicity.fit(odd_docs, marks)).collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert toxicity.scored(odd_docs.withColumnRenamed("size", "score").withColumnRenamed("_id", "predicted"), None).where("score = 0").count() == 11
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, labels)).count() == 0


# --- licences ---


def dice_brute(text, threshold=0.8):
    """Best licence by comparing every line and paragraph, and every window with an anchor in its place, with every template."""
    best = []
    plain = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
    units = plain.split("\n") + [re.sub(r"[ \n]+", " ", p) for p in re.split(r"\n *\n[ \n]*", plain) if "\n" in p.strip(" ")]
    for u in units:
        w = [x for x in u.split(" ") if x]
        b = set(zip(w, w[1:], strict=False))
        for name, template in licenses.TEMPLATES:
            t = {tuple(x.split(" ")) for x in licenses.bigrams(template)}
            if b and 2 * len(b & t) / (len(b) + len(t)) >= threshold:
                best.append((-2 * len(b & t) / (len(b) + len(t)), name))
    words, laid = plain.split(), licenses.anchors(licenses.template_rows())
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        t = {tuple(x.split(" ")) for x in licenses.bigrams(template)}
        places = [(*b.split(" "), o) for b, found in laid.items() for j, o in found if j == k]
        size = len(licenses.words_of(template))
        for start in range(-size, len(words)):
            if any(0 <= start + o < len(words) - 1 and (words[start + o], words[start + o + 1]) == (x, y) for x, y, o in places):
                run = words[max(0, start) : start + size]
                b = set(zip(run, run[1:], strict=False))
                if b and 2 * len(b & t) / (len(b) + len(t)) >= threshold:
                    best.append((-2 * len(b & t) / (len(b) + len(t)), name))
    return (None, 0.0, 0) if not best else (min(best)[1], -min(best)[0], len(best))


def test_licenses_equal_brute_force(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES[4][1]
    whole = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "BSD-2-Clause", "Zlib")}
    inside = [
        "A tool for maps of towns. Released under the MIT License. It reads all common formats and more.", "/* x.js v2 (c) us, licensed under the apache license, version 2.0, minified */ var a=1",
        "Copyright (c) 2001\n\n" + "\n\n".join(x.replace(", ", ",\n") for x in whole["MIT"].split(". ")), "before it " + whole["BSD-2-Clause"] + " after it", whole["Zlib"][:150] + " and something else that goes on for a while instead",
    ]
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0", mit, "\n".join(mit.split(". ")), "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend", "This work is licensed under the GNU General Public License, version 3.", "nothing here", "Mit lizenz", mit + " " + mit, *inside]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = licenses.scan(docs).collect()
    want = sorted((str(r["doc_id"]), *map(str, dice_brute(r["text"]))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), str(r["license"]), str(r["dice"]), str(r["n_hits"])) for r in got) == want
    assert [dice_brute(t)[0] for t in inside] == ["MIT", "Apache-2.0", "MIT", "BSD", None]  # the short notice of all BSD licences is as near as the text
    assert licenses.scan(no_docs).count() == 0
    for r in licenses.template_rows():
        assert r["lo"] <= r["n"] <= r["hi"] and math.isclose(0.8 / 1.2, r["n"] / (r["n"] / (0.8 / 1.2)))


# --- media ---


def test_streams():
    for text in (None, "", "abc", "x" * 64, "x" * 65, "é" * 5000, "y" * 100_000):
        n, raw = media.padded(text)
        stream = media.Stream(media.encode(raw))
        assert stream.payload() == raw and len(raw) % 64 == 0 and len(raw) > 0 and n == len((text or "").encode())
        assert stream.crc_bad == 0 and stream.table_frames == len(stream.offsets) and stream.table_bytes == len(stream.data) - stream.offsets[0] + 209 - 0 or stream.table_bytes > 0
        assert stream.seconds == pytest.approx(stream.samples / 32000)
    made = media.encode(media.padded("hello" * 3000)[1])
    whole = media.Stream(made)
    torn = media.Stream(made[: whole.offsets[2]] + b"\xff\xfbgarbage\xff" * 3 + made[whole.offsets[2] :] + b"TAG" + bytes(125))
    assert torn.payload() == whole.payload() and torn.skipped == 30 and len(torn.offsets) == len(whole.offsets)
    hurt = bytearray(made)
    hurt[whole.offsets[1] + 8] ^= 1
    assert media.Stream(bytes(hurt)).crc_bad == 1
    assert media.Stream(b"").seconds == 0 and media.Stream(b"\xff" * 100).offsets == []


def test_digests_equal_their_definition(spark):
    """Sizes, digests and frames worked out again: from the text, and by a walk over the stored bytes."""
    texts = ["", "a", "x" * 64, "é" * 777, "TAG" * 300, "line\n" * 9000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.to_media(docs).collect()}
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    for r in media.digests(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        data = stored[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        at, frames, body = 10 + int("".join(f"{b:07b}" for b in data[6:10]), 2), [], b""
        while at < len(data):
            assert data[at] == 0xFF and data[at + 1] == 0xFA and data[at + 2] >> 2 & 3 == 2
            size = 144000 * kbps[data[at + 2] >> 4] // 32000
            crc = 0xFFFF
            for bit in "".join(f"{b:08b}" for b in data[at + 2 : at + 4] + data[at + 6 : at + 23]):
                crc = (crc << 1 ^ (0x8005 if (crc >> 15) != int(bit) else 0)) & 0xFFFF
            assert crc == int.from_bytes(data[at + 4 : at + 6], "big")
            frames.append(at)
            body += data[at + 23 : at + size] if len(frames) > 1 else b""
            at += size
        assert at == len(data) and r["frame_offsets"] == frames[1:] and body[: len(payload)] == payload and not any(body[len(payload) :])
        assert r["seconds"] == (len(frames) - 1) * 1152 / 32000 and r["feature"].startswith(f"frames={len(frames) - 1};")


def test_tags_and_tables_of_other_writers():
    frame = bytes((0xFF, 0xFB, 0x90, 0xC4)) + bytes(413)  # 128 kbit/s at 44.1 kHz, without CRC
    steps = [834, 1251]
    vbri = (bytes((0xFF, 0xFB, 0x90, 0xC4)) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 6, 5, 2, 1, 2, 2) + struct.pack(">HH", *steps)).ljust(417, b"\0")
    title = b"TIT2" + bytes((0, 0, 0, 5)) + b"\0\0\3song"
    extended = bytes((0, 0, 0, 6, 1, 0))
    body = extended + title
    footer = b"3DI\4\0\x50" + bytes((0, 0, 0, len(body)))
    stream = media.Stream(b"ID3\4\0\x50" + bytes((0, 0, 0, len(body))) + body + footer + vbri + frame * 5)
    start = 10 + len(body) + 10 + 417
    assert stream.tags == {"TIT2": "song"} and (stream.table_frames, stream.table_bytes, stream.seek_steps, stream.skipped) == (5, 417 * 6, steps, 0)
    assert stream.offsets == [start + 417 * i for i in range(5)] and stream.seconds == 5 * 1152 / 44100
    old = b"ID3\3\0\x40" + bytes((0, 0, 0, 10 + len(title))) + struct.pack(">I", 6) + bytes(6) + title
    assert media.Stream(old + frame * 3).tags == {"TIT2": "song"} and len(media.Stream(old + frame * 3).offsets) == 3


def test_media_of_odd_rows(spark, odd_docs, no_docs):
    read = media.read_media(media.to_media(odd_docs)).collect()
    assert sorted(bytes(r["payload"]) for r in read) == sorted(media.padded(r["text"])[1] for r in odd_docs.collect())
    digests = media.digests(odd_docs).collect()
    assert sorted(r["feature"] for r in digests) == sorted(r["feature"] for r in read) and len(digests) == 11
    assert media.digests(no_docs).count() == 0 and json.dumps(digests[0]["n_bytes"])


# --- findings of the first review ---


def test_long_runs_are_scored_to_their_end():
    run = "".join(chr(0x4E00 + 7 * i) for i in range(213))
    pieces = toxicity.words_of(run)
    assert all(any(run[i : i + 5] in p for p in pieces) for i in range(len(run) - 4))
    assert toxicity.words_of("x" * 40 + " y") == ["x" * 40, "y"]
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    model.share[sorted(toxicity.subwords("insult") - toxicity.subwords("a" * 30))] = 50
    scorer = toxicity.Scorer(model)
    filler = "".join(chr(97 + i * i % 23) for i in range(90))
    assert scorer.score(filler + "insult" + filler) > scorer.score(filler + filler) + 0.1


def test_toxic_runs_score_alike_at_every_offset():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    bad = [f"bad{i}" for i in range(10)]
    for w in bad:
        model.share[sorted(toxicity.subwords(w))] = 2
    clean = [chr(0x3B1 + i % 24) * (1 + i % 2) for i in range(40)]
    scores = [toxicity.Scorer(model).score(" ".join(clean[:k] + bad + clean[k:])) for k in range(20)]
    assert max(scores) - min(scores) < 1e-6


@pytest.mark.parametrize("text, clear, kind", [
    ("pay BE68 5390 0754 7034 BIC GKCC now", "BE68 5390 0754 7034", "iban"),
    ("pay ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "iban"),
    ("pay BE68 5390 0754 7034 GKCCBEBB", "BE68 5390 0754 7034", "iban"),
    ("no ID12 4111 1111 1111 1111 here", "4111 1111 1111 1111", "card"),
])
def test_values_within_failed_candidates(text, clear, kind):
    for key in map(str, range(300)):
        done, kinds = pii.Pseudonyms(key).apply(text)
        assert kinds == [kind] and clear not in done and len(done) == len(text)
        assert pii.Pseudonyms(key, -1).apply(done) == (text, [kind])


def test_payloads_that_look_like_trailing_tags():
    size = len(media.encode(b"x" * 128))
    for mark in (b"TAG", b"APETAGEX"):
        for n in (64, 128, 192, 5000):
            for at in range(n - len(mark) + 1):
                body = b"y" * at + mark + b"z" * (n - at - len(mark))
                if n < 5000 or at > n - 200:
                    data = media.encode(body)
                    assert media.Stream(data).payload() == body
                    assert media.Stream(data + b"TAG" + b"t" * 125).payload() == body
    whole = media.encode(b"x" * 128)
    with pytest.raises(ValueError):
        media.Stream(whole[: size - 40]).payload()
