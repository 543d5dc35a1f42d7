import pytest

from cuewright import settings
from cuewright.telemetry import Trace, elapsed_ms, summary


def test_settings(tmp_path):
    base = settings.parse("---\nlanguage: de\ntarget_ms: 100\nmaximum_ms: '200'\n---\nBe brief.\n")
    assert base == {"language": "de", "target_ms": 100, "maximum_ms": 200, "instructions": "Be brief."}
    made = settings.merged(base, settings.parse("No front matter."), {"language": "fr"})
    assert (made.language, made.target_ms, made.depth, made.instructions) == ("fr", 100, "detailed", "Be brief.\n\nNo front matter.")
    for bad in ("---\nlanguage: x", "---\ncolour: x\n---\n"):
        with pytest.raises(ValueError):
            settings.parse(bad)
    with pytest.raises(ValueError):
        settings.merged({"target_ms": 700_000})
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "S.md").write_text("x")
    assert settings.nearest("S.md", tmp_path / "a/b") == tmp_path / "S.md" and settings.nearest("none.md", tmp_path) is None


def test_trace(spark):
    trace = Trace()
    with trace.span("a", n=1):
        pass
    with pytest.raises(KeyError), trace.span("a"):
        raise KeyError
    rows = trace.table(spark)
    assert [(r.name, r.spans, r.errors) for r in summary(rows).collect()] == [("a", 2, 1)] and elapsed_ms(rows).first()[0] >= 0
