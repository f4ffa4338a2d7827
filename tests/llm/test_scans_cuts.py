import random

import numpy as np

from foliospark.llm import labelled_pages, scans, truncation

OCR = "ocr_id long, scan_id long, page_no int, text string, confidence double"


def _scan():
    """Pages of known text, with a header, page numbers, broken and misread words."""
    rng = random.Random(5)
    words = "keeper bridge garden lantern harbour window quiet table report market silver thunder remember beyond copper another".split()
    pages, wanted = [], []
    for scan in range(25):
        for page in range(1, 9):
            lines, truth = [f"The Harbour Report {scan}", ""], [("running", 1)]
            for _ in range(14):
                lines.append(" ".join(rng.choice(words) for _ in range(8)))
            for at in range(2, 16):
                if rng.random() < 0.15:
                    tokens = lines[at].split(" ")
                    k = rng.randrange(1, 7)
                    bad = {"e": "c", "h": "b", "m": "rn", "o": "0", "i": "1"}
                    swap = next((c for c in tokens[k] if c in bad), None)
                    if swap:
                        tokens[k] = tokens[k].replace(swap, bad[swap], 1)
                        lines[at] = " ".join(tokens)
                        truth.append(("misread", at + 1))
                if at < 15 and rng.random() < 0.15:
                    last = lines[at].rsplit(" ", 1)[1]
                    if last in words and len(last) > 5:
                        lines[at] = lines[at][: -len(last)] + last[:3] + "-"
                        lines[at + 1] = last[3:] + " " + lines[at + 1]
                        truth.append(("split", at + 1))
            lines += ["", f"[{page}]"]
            truth.append(("running", len(lines)))
            ocr = scan * 100 + page
            pages.append((ocr, scan, page, "\n".join(lines), 0.8))
            wanted += [(ocr, n, kind) for kind, n in truth]
    return pages, set(wanted)


def test_known_errors_are_found(spark):
    pages, wanted = _scan()
    found = {(r["ocr_id"], r["line_no"], r["kind"]) for r in scans.page_findings(scans.prepare(spark.createDataFrame(pages, OCR))).collect()}
    for kind in ("running", "split", "misread"):
        want, have = {x for x in wanted if x[2] == kind}, {x for x in found if x[2] == kind}
        assert len(want & have) / len(want) > 0.95 and len(want & have) / len(have) > 0.95, kind


def test_paragraphs_go_on_over_pages(spark):
    body = "the keeper walked over the bridge and the garden was quiet again\n" * 6
    pages = [(1, 1, 1, body + "and then the har-", 0.9), (2, 1, 2, "bour closed for the night.\n\nAnother day began.", 0.9), (3, 1, 4, "Alone here.", 0.9), (4, 2, 1, None, None), (5, 2, 2, "", 0.5)] + [(10 + k, 5 + k, 1, body + "the harbour closed.", 0.9) for k in range(4)]
    found = {(r["scan_id"], r["page_no"], r["part"]): r["text"] for r in scans.paragraphs(spark.createDataFrame(pages, OCR)).collect()}
    assert found[1, 1, 1].endswith("and then the harbour closed for the night.") and found[1, 2, 2] == "Another day began." and found[1, 4, 1] == "Alone here."
    assert (1, 2, 1) not in found and not any(k[0] == 2 for k in found)


def test_compounds_keep_their_hyphen():
    model = scans.ScanModel({"well-known": 40, "keeper": 50, "known": 10, "bridge": 60}, {}, {"well": 40}, 1000)
    reader = scans.PageReader(model, {-1: 1.0})
    assert not reader.split("a well-", "known") and reader.split("the brid-", "ge") and not reader.split("a well-", None) and reader.split("the brid\u00ac", None) and not reader.split("no hyphen", "x")


def test_endings():
    kind = lambda text: truncation.ending(text, "").kind
    say = lambda text: truncation.ENDING.get(kind(text), 0.0)
    whole = ["A sentence.", "# Title\n\nText ends here.", "```\ncode\n```", "$$x$$", "", "   ", "<ul>\n<li>a</li>\n</ul>", "Text.\n\nShare this page →", "Text.\n\nBy Ann Miller · 2 May 2021", "Please enable JavaScript to view this page.", "404 Not Found", "Loading…"]
    cut = ["The keeper walked…", "Half a word [...]", "Text goes on\ufffd", "```\ncode", "<ul>\n<li>a</li>", "Text with a [link](https://exam", "One. The keeper walked Read more", "Text <a href=\"/x", "$$\nx +"]
    assert all(say(t) < -2 for t in whole) and all(say(t) > 2 for t in cut)
    assert kind("The keeper walked to the gate. Nobody expec") == "sentence" and kind("Text.\n\nShare: Mail | Copy link | Print") == "text"


def test_every_length_speaks_for_or_against_a_cut():
    rng = np.random.default_rng(4)
    true = np.exp(rng.normal(5.5, 0.5, 4000)).astype(int) + 1
    limit = 300
    kept = np.minimum(true, limit)
    lengths, n = np.unique(kept, return_counts=True)
    ends = np.where(lengths == limit, (true > limit).sum(), 0).astype(float)
    fit = truncation.fit_lengths(lengths, n.astype(float), ends, None)
    assert abs(fit.mean - 5.5) < 0.05 and abs(fit.spread - 0.5) < 0.05 and list(fit.limits) == [limit]
    said = dict(zip(lengths.tolist(), truncation.length_evidence(fit, lengths)))
    assert said[limit] > 3 and said[200] < -1 and said[299] < -1
    # a source of a few values leans on the fit over all, and knows its limits
    small = truncation.fit_lengths(np.array([150, 300]), np.array([1.0, 1.0]), np.array([0.0, 1.0]), fit)
    assert abs(small.mean - 5.5) < 0.1 and truncation.length_evidence(small, np.array([300]))[0] > 3
    short = truncation.fit_lengths(np.array([20, 25]), np.array([1.0, 30.0]), np.array([0.0, 30.0]), fit)
    assert 25 in short.limits


def test_limits_stand_out(spark):
    """Texts of one site are cut at 300 characters: all of those are found, and no others."""
    rng = random.Random(8)
    pages, wanted = [], set()
    for k in range(260):
        text, least = "", rng.choice((200, 500, 700))
        while len(text) < least:
            text += rng.choice(labelled_pages.SENTENCES[:6]) + " "
        text = text.strip()
        if k % 3 == 0 and len(text) > 300:
            text = text[:300]
            wanted.add(k)
        pages.append((k, f"https://a.example/{k}", "static", text))
    frame = spark.createDataFrame(pages, "fetch_id long, url string, strategy_used string, content string")
    none = spark.createDataFrame([], "meta_id long, domain string, title string, description string")
    said = {r["chars"]: r["llr"] for r in truncation.lengths(truncation.endings(frame, none)).where("scope = 'domain'").collect()}
    assert max(said, key=said.get) == 300 and sum(v > 2.5 for v in said.values()) == 1 and min(said.values()) < 0
    found = {r["row_id"] for r in truncation.cut_values(frame, none).where("log_odds > 0").collect()}
    assert len(found & wanted) >= 0.98 * len(wanted) and len(found - wanted) <= 1


def test_descriptions_may_be_titles():
    judge = lambda text, title, site="": truncation._described(text, title, site, truncation.ending(text, site)).kind
    assert judge("How to mend a clock", "How to mend a clock") == "title" and judge("How to mend a cl", "How to mend a clock") == "title open" and judge("How to mend a clock", "How to mend a clock | Harbor Notes") == "title"
    assert judge("Old maps | New maps | Harbor Notes", None, "harbornotes.example") == "site" and judge("Old maps, New maps, Harbor Notes", "x", "harbor-notes.example") == "site" and judge("Old maps | New ma", None, "harbornotes.example") == "parts"
