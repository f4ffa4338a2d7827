from foliospark.llm import scans


def test_repeated_misreadings_are_found_in_a_large_corpus():
    """The same shares in a corpus ten times as large: what was rare stays rare."""
    read = []
    for times in (1, 10):
        words = {"0": 9_000 * times, "in": 20_000 * times, "summer": 500 * times, "sumrner": times, "surnrner": times, "19O2": 2 * times, "B2B": 400 * times}
        model = scans.ScanModel(words, {("in", "0"): 900 * times, ("in", "summer"): 300 * times}, {}, 465_000 * times)
        assert scans.shape_misread("19O2", model) and not scans.shape_misread("B2B", model)
        assert "summer" in [w for w, _ in model.candidates("surnrner")]
        reader = scans.PageReader(model, {-1: 1.0})
        read.append(reader.read(scans.text_lines("in 19O2\nin 1902\nin surnrner\nin sumrner", set()), None, None))
        assert (1, "misread") in read[-1][0] and (2, "misread") not in read[-1][0]
    assert read[0] == read[1]
