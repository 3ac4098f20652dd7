import os

from glossweave.__main__ import main

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def test_commands(spark, tmp_path, capsys):
    d = tmp_path / "d.tsv"
    rows = [["1", "说", "說", "shuō", "say"], ["2", "四", "\\N", "sì", "four"], ["3", "四季", "\\N", "sìjì", "the four seasons"], ["4", "四时", "\\N", "sìshí", "the four seasons"]]
    d.write_text("".join("\t".join([*r, "verb", *["\\N"] * 8, "", "1"]) + "\n" for r in rows), encoding="utf-8")
    run = lambda *a: main([*a, "--dictionary", str(d)], spark).collect()
    assert run("lookup", "說")[0].english == "say"
    assert run("tokens", "說四季")[0].tokens == ["說", "四季"]
    assert run("simplified", "說四")[0].simplified == "说四"
    assert run("traditional", "说四")[0].converted == "說四"
    assert {r.key for r in run("similar", "四季")} == {"四时"}
    assert any("四季" in r.line for r in run("to_cedict"))
    main(["count", "characters", "--input", f"{HERE}/shijing001.txt", "--output", str(tmp_path / "out")], spark)
    assert any(x.startswith("part-") for x in os.listdir(tmp_path / "out"))
    assert run("count", "bigrams", "--input", f"{HERE}/shijing001.txt")
    assert run("count", "terms", "--input", f"{HERE}/shijing001.txt")
    mi = run("mutual_information", "--characters", f"{HERE}/char_freq.tsv", "--bigrams", f"{HERE}/char_bigram_freq.tsv", "--terms", f"{HERE}/term_freq.tsv")
    assert len(mi) == 241
    assert len(run("evaluation", "--input", f"{HERE}/annotated.md", "--information", f"{HERE}/mutual_info.tsv")) == 30
    assert len(run("relevance", "--input", f"{HERE}/training_balanced.csv", "--validation", f"{HERE}/validation_biyan.csv")) == 5
    assert len(run("token_filter", "--input", f"{HERE}/training_example.tsv")) == 30
    assert "If (" in capsys.readouterr().out
