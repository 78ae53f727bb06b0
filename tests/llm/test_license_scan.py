import json
import random
import textwrap

import numpy as np

from hiretide.llm import license_scan as L
from hiretide.llm import queries

SF = "/root/testdata/sf0.1"


def test_every_template_is_found_as_itself():
    scanner = L.Scanner(L.TEMPLATES)
    for name, text in L.TEMPLATES:
        found = scanner.scan(text.encode())
        assert found["license"] == name and found["confirmed"] and found["exact"], name
        assert L.blocks_of(text.encode()), name


def test_wording_differences():
    scanner = L.Scanner(L.TEMPLATES)
    found = scanner.scan(b"Code: released under the nice MIT License (see file).")
    assert found["license"] == "MIT" and found["confirmed"] and not found["exact"] and found["extra"] == "nice" and found["missing"] == ""
    mit = dict(L.TEMPLATES)["MIT"].replace("free of charge, ", "")
    found = scanner.scan(mit.encode())
    assert found["license"] == "MIT" and found["confirmed"] and found["missing"] == "free of charge"
    gpl = scanner.scan(b"This work is licensed under the GNU General Public License, version 2.")
    assert gpl["license"] == "GPL-2.0"
    other = scanner.scan(b"She got her licence to drive a bus in the spring of that year, and a permit later.")
    assert not other["confirmed"]


def test_blocks():
    text = "no\nReleased under the MIT License.\nnothing here\n" + "Pad words here. " * 200 + "Licensed under CC BY 4.0. " + "More pad. " * 300
    raw = text.encode()
    shown = [raw[a:b].decode().strip() for a, b in L.blocks_of(raw)]
    assert shown == ["Released under the MIT License.", "Licensed under CC BY 4.0."]
    assert L.blocks_of(None) == L.blocks_of(b"") == L.blocks_of(b"plain words") == []


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {name: text for name, text in L.TEMPLATES if len(text) < 80}
    got = queries.QUERIES["op2_license_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        want = {name for name, text in L.TEMPLATES if text in short.values() and text in docs[r["doc_id"]]}
        planted += bool(want)
        assert set(filter(None, r["licenses"].split(","))) == want
        assert len(json.loads(r["blocks"])) == r["n_blocks"]
    assert planted > 30


def test_edges(spark):
    rows = [(1, None, 1), (1, "", 2), (2, "Released under the MIT License.", 3), (2, "Released under the MIT License.", 3), (None, "x " * 300000 + "Licensed under CC BY-NC 4.0.", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = L.scan_licenses(docs).collect()
    assert [len(r["blocks"]) for r in got] == [0, 0, 1, 1, 1] and got[4]["blocks"][0]["license"] == "CC-BY-NC-4.0"
    assert L.scan_licenses(docs.limit(0)).count() == 0


def confirmed(text):
    return [(b["license"], b["exact"]) for b in L.Scanner(L.TEMPLATES).find(text.encode()) if b["confirmed"]]


def test_wrapped_notices_are_found():
    for name, text in L.TEMPLATES:
        for mark in ("", "# ", " * ", "// "):
            for end in ("\n", "\r\n"):
                lines = [mark + x for x in textwrap.wrap(text, 79 if len(text) > 79 else 20)]
                shown = end.join([mark + "Some file of words", mark.rstrip(), *lines, mark.rstrip(), mark + "More words of it", ""])
                assert confirmed(shown) == [(name, True)], (name, mark, end)
    # a line without a word ends the notice
    assert confirmed("Released under\n#\nthe MIT License.") == []


def test_notices_inside_lines_of_any_length():
    pad = "The quick brown fox jumps over the lazy dog while many other words go by, as they do. "
    for n in (0, 1, 2, 4, 10, 40):
        for text in (pad * n + "Released under the MIT License. " + pad * n, pad.replace(" ", "_") * n + " Released under the MIT License. " + pad):
            blocks = [b for b in L.Scanner(L.TEMPLATES).find(text.encode()) if b["confirmed"]]
            assert [(b["license"], b["exact"], b["block"]) for b in blocks] == [("MIT", True, "Released under the MIT License")], n


def test_every_notice_of_a_line_is_reported():
    assert confirmed("Released under the MIT License. Licensed under CC BY-NC 4.0.") == [("MIT", True), ("CC-BY-NC-4.0", True)]
    assert confirmed(" ".join(t for _, t in L.TEMPLATES)) == [(n, True) for n, _ in L.TEMPLATES]
    assert confirmed("Released under the MIT License. " * 3) == [("MIT", True)] * 3
    left = L.Scanner(L.TEMPLATES).find(b"Copyright somebody, 2020. Released under the MIT License.")
    assert [b["confirmed"] for b in left] == [False, True]


def test_found_in_the_table(spark):
    text = "\n".join("# " + x for x in textwrap.wrap(dict(L.TEMPLATES)["MIT"], 79))
    docs = spark.createDataFrame([(1, text), (2, "Released under the MIT License. Licensed under CC BY 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: [b["license"] for b in r["blocks"] if b["confirmed"]] for r in L.scan_licenses(docs).collect()}
    assert got == {1: ["MIT"], 2: ["MIT", "CC-BY-4.0"]}


def test_equal_sizes_are_told_by_wording():
    scanner = L.Scanner(L.TEMPLATES)
    for n in "23":
        block = f"This work is licensed under the GNU General Public License, version {n}".encode()
        sizes = [len(c.compress(block.lower())) for c in scanner.with_template]
        if n == "3":
            assert sizes.count(min(sizes)) > 1  # a last character of its own costs nothing
        found = scanner.scan(block)
        assert found["license"] == f"GPL-{n}.0" and found["exact"]
    twins = L.Scanner([("A", "Licensed under one two three."), ("B", "Licensed under one two three.")])
    assert twins.scan(b"licensed under one two three")["license"] == "A"


def test_blocks_do_not_depend_on_the_length_of_a_line():
    part = "The licence of part {} was granted late. Nobody spoke of it. "
    for n in (1, 5, 20, 60, 200):
        text = "".join(part.format(i) for i in range(n))
        in_one, in_many = (L.Scanner(L.TEMPLATES).find(t.encode()) for t in (text, text.replace(". ", ".\n")))
        assert len(in_one) == len(in_many) == n
        assert [(b["license"], b["conditional"], b["confirmed"]) for b in in_one] == [(b["license"], b["conditional"], b["confirmed"]) for b in in_many]


def test_a_whole_licence_is_as_many_templates_as_paragraphs(spark):
    whole = dict(L.TEMPLATES)["MIT"] + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    shown = "\n".join(textwrap.wrap(whole.split("\n\n")[0], 60)) + "\n\n" + "\n".join(textwrap.wrap(whole.split("\n\n")[1], 60))
    docs = spark.createDataFrame([(1, shown)], "doc_id long, text string")
    blocks = L.scan_licenses(docs, templates=[("MIT", whole), ("Other", "Licensed under some other words.")]).first()["blocks"]
    assert [(b["license"], b["template"], b["exact"], b["confirmed"]) for b in blocks] == [("MIT", 0, True, True), ("MIT", 1, True, True)]


def brute_force(scanner, text):
    """Every window of a template's length, with every template; the greatest saving first, none over another."""
    own = text.encode().lower().split()
    ranked = []
    for k, words in enumerate(scanner.words):
        for i in range(len(own)):
            wide = own[i:i + len(words) + max(2, len(words) // 4)]
            if own[i] in words and sum(w in words for w in wide) >= L.HOLDS * len(words):
                block = b" ".join(own[i:i + len(words)])
                ranked.append((len(scanner.with_template[k].compress(block)) - len(scanner.plain.compress(block)), i, k))
    taken, out = set(), []
    for _, i, k in sorted(ranked):
        if i in taken:
            continue
        around = max(2, len(scanner.words[k]) // 4)
        first = last = i
        while first > max(0, i - around) and first - 1 not in taken:
            first -= 1
        while last < min(len(own), i + len(scanner.words[k]) + around) and last not in taken:
            last += 1
        near = scanner._confirm(k, own[first:last])
        if near["held"] < L.HOLDS:
            continue
        x, y = max(first, first + near["inside"][0] - near["lost"][0]), min(last, first + near["inside"][1] + near["lost"][1])
        found = scanner.scan(b" ".join(own[x:y]))
        if found["confirmed"]:
            x, y = x + found["inside"][0], x + found["inside"][1]
            taken |= set(range(x, y))
            out.append((x, y, found["license"], found["template"], found["conditional"], found["missing"], found["extra"]))
    return sorted(out)


def test_against_all_windows_and_all_templates():
    templates = [(n, " ".join(w.decode() for w in L.plain_words(t.encode()))) for n, t in L.TEMPLATES]
    scanner, rng, met = L.Scanner(templates), random.Random(5), 0
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choices("some work of the license under which all may be granted copies by".split(), k=rng.randint(0, 12))
            notice = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, 1 + len(notice) // 8)):  # words lost, put in, and changed
                at = rng.randrange(len(notice))
                notice[at:at + rng.randint(0, 1)] = rng.choices(["kindly", "work", "license"], k=rng.randint(0, 1))
            words += notice
        text = " ".join(words)
        place = {n: i for i, n in enumerate(np.cumsum([0, *(len(w) + 1 for w in words[:-1])]).tolist())}
        got = [(place[b["first"]], place[b["first"]] + len(b["block"].split()), b["license"], b["template"], b["conditional"], b["missing"], b["extra"])
               for b in scanner.find(text.encode()) if b["confirmed"]]
        assert got == brute_force(scanner, text)
        met += len(got)
    assert met > 80


def test_an_input_column_named_like_the_output_is_replaced(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x")], "doc_id long, text string, blocks string")
    got = L.scan_licenses(docs)
    assert got.columns == ["doc_id", "blocks"] and got.first()["blocks"][0]["license"] == "MIT"
