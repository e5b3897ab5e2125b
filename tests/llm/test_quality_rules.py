import re

from polyspark.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {t for t in tri if tri.count(t) > 1} if len(tri) < 3000 else {t for t in set(tri) if tri.count(t) > 1}
    cover = {i + k for i, t in enumerate(tri) if t in twice for k in range(3)}
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(cover),
        len(w) < 50 or 100 * len(cover) > 50 * len(w),
    )


def test_against_brute_force(docs):
    got = quality_rules.clean_lines(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.kept and r.base_failed)
        if not r.n_bad_lines:
            assert r.clean_text == (r.text or "")


def test_lines_are_removed_and_losing_too_much_rejects(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{good}\n\nhome | about | more | help\n{good[::-1]}"), (2, good + "\n" + "\n".join(f"SHOUT NUMBER LOUD{i} AGAIN{i} MORE{i}" for i in range(40)))]
    out = {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and out[1].clean_text == f"{good}\n\n{good[::-1]}" and out[1].n_bad_lines == 1
    assert not out[2].kept and not out[2].base_failed


def test_empty_table(none):
    assert quality_rules.clean_lines(none).count() == 0


def test_no_python_in_the_plan(docs):
    plan = quality_rules.clean_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_helper_names_of_the_table_stay(spark):
    rows = [(1, "word " * 60, 1, 2, 3), (2, None, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __words int, __lines int, __HASHES int")
    got = {r.doc_id: r for r in quality_rules.clean_lines(df).collect()}
    assert (got[1]["__words"], got[1]["__lines"], got[1]["__HASHES"], got[1].n_words) == (1, 2, 3, 60) and got[2].n_words == 0
