"""Words of any length are scored whole."""

from riskloom.llm.language import Model, segments


def test_run_together_text():
    m = Model({("de", w): 5.0 for w in "verschlüsselung netzwerkdienst kennwort".split()} | {("it", w): 5.0 for w in "crittografia collegamento password".split()})
    start, rest = "verschlusselungen" * 4, "collegamenticrittografici" * 40
    assert next(segments(m, start))[1] == "de"
    assert next(segments(m, start + rest))[1] == "it" and next(segments(m, start + rest))[1] == "it"
    assert max(len(k) for k in m.row) <= 64
