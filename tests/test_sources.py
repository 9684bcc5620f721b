from candor.sources import corpus


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_questions_answers_scores(spark, tmp_path):
    (tmp_path / "questions").mkdir()
    (tmp_path / "questions/questions").write_text("What?\nWhy?\n")
    for name, text in {"0": "one\n\nthree\n", "10": "x\n"}.items():
        (tmp_path / "answers").mkdir(exist_ok=True)
        (tmp_path / "answers" / name).write_text(text)
        (tmp_path / "scores").mkdir(exist_ok=True)
        (tmp_path / "scores" / name).write_text("5 4.5\n\t0.125\n")
    data = corpus.dataset(spark, str(tmp_path))
    assert rows(data["questions"], "question_id") == [(0, "What?", 30), (1, "Why?", 30)]
    assert rows(data["answers"], "question_id", "owner_id") == [(0, 0, "one"), (0, 1, ""), (0, 2, "three"), (10, 0, "x")]
    assert rows(data["scores"].where("question_id = 10"), "owner_id") == [(10, 0, 5.0), (10, 1, 4.5), (10, 2, 0.125)]
    assert data["exams"].count() == 12 and data["exams"].agg({"n_questions": "sum"}).first()[0] == 87


def test_word_model(spark, tmp_path):
    (tmp_path / "vectors").write_text("a 3 4\nb 1 0\na 0 2\n\n")
    model = corpus.raw_word_model(spark, str(tmp_path / "vectors"))
    assert {r.word: list(r.vec) for r in model.collect()} == {"a": [0.0, 1.0], "b": [1.0, 0.0]}
    corpus.save_word_model(model, str(tmp_path / "model"))
    assert corpus.load_word_model(spark, str(tmp_path / "model")).count() == 2


def test_renumbered_takes_two_numbers(spark):
    ids = spark.createDataFrame([(i,) for i in ("11.1", "11.10", "11.2", "2.1")], "id string")
    assert [r[0] for r in rows(corpus.renumbered(ids), "place")] == ["2.1", "11.1", "11.2", "11.10"]


def test_label_counts(spark, tmp_path):
    (tmp_path / "a").write_text(";Node\n0\tx\ty\n2\tx\ty\nno\n1\tz\tz\n;Edge\n0\tx\ty\n")
    (tmp_path / "b").write_text("0\tx\ty\n")
    counts = corpus.label_counts(corpus.numbered_lines(spark, str(tmp_path)))
    assert rows(counts, "file") == [("a", 1, 2), ("b", 1, 0)]
    assert rows(corpus.label_totals(counts), "zero") == [(2, 2)]


def test_series(spark, tmp_path):
    (tmp_path / "s").write_text("".join(f"{k / 10}\n" for k in range(20)))
    s = corpus.series(corpus.numbered_lines(spark, str(tmp_path / "s")))
    assert rows(s, "exam_id", "top_k")[10] == (2, 1, 1.0)
    assert corpus.paired(s, s).count() == 20


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    files = {f"f{k}": [f"{k} line {j} " + "x" * (j % 50) for j in range(2000 * k)] for k in range(4)}
    for name, lines in files.items():
        (tmp_path / "d" / name).write_text("".join(x + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = {}
        for r in corpus.numbered_lines(spark, str(tmp_path / "d")).collect():
            got.setdefault(r.file, {})[r.line] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: dict(enumerate(x)) for n, x in files.items() if x}


def test_first_answer_in_an_order(spark):
    a = spark.createDataFrame([(0, 0, 2, "a"), (0, 0, 1, "b"), (0, 1, 1, None)], "question_id int, owner_id int, at int, raw_answer string")
    assert rows(corpus.unique_answers(a, order="at"), "owner_id") == [(0, 0, "b"), (0, 1, None)]


def test_first_answer_and_stripped(spark):
    a = spark.createDataFrame([(0, 0, "b"), (0, 0, "a")], "question_id int, owner_id int, raw_answer string")
    assert rows(corpus.unique_answers(a), "owner_id") == [(0, 0, "a")]
    assert corpus.stripped(spark.createDataFrame([("1.1 a  b",)], "value string")).first()[0] == "a b"


def test_graded_corpus(spark, tmp_path):
    from candor.__main__ import graded
    from candor.config import Config

    words = {"stack": (1, 0, 0), "queue": (0, 1, 0), "tree": (0, 0, 1), "list": (0.8, 0.6, 0), "graph": (0, 0.6, 0.8), "node": (0.6, 0, 0.8)}
    (tmp_path / "vectors").write_text("".join(f"{w} {' '.join(map(str, v))}\n" for w, v in words.items()))
    texts = ["a stack and a list", "the tree of nodes, a graph", "queue", "stack stack node", "", "list of lists"]
    (tmp_path / "questions").mkdir()
    (tmp_path / "questions/questions").write_text("".join(f"Question {q}?\n" for q in range(8)))
    for d in ("answers", "scores"):
        (tmp_path / d).mkdir()
    for q in range(8):
        (tmp_path / f"answers/{q}").write_text("".join(f"{texts[(q + k) % 6]}\n" for k in range(5)))
        (tmp_path / f"scores/{q}").write_text(" ".join(str((q + k) % 6) for k in range(5)))
    model = corpus.raw_word_model(spark, str(tmp_path / "vectors"))
    got = {(r.exam_id, r.top_k): r.average for r in graded(spark, str(tmp_path), model, top=5, config=Config(clusters=3, max_iter=3, sweeps=2)).collect()}
    assert set(got) == {(e, k) for e in (1, 2) for k in range(1, 6)}
    # with all five answers the mean is that of all grades, over the sizes that the exams have
    every = lambda qs: sum((q + k) % 6 for q in qs for k in range(5))
    assert abs(got[1, 5] - every(range(7)) / 35) < 1e-9 and abs(got[2, 5] - every([7]) / 35) < 1e-9


def test_words_of_a_file_in_several_blocks(spark, tmp_path):
    lines = ["  ".join(f"{k}.{j}" for j in range(k % 4)) for k in range(4000)]
    (tmp_path / "3").write_text("\n".join(lines) + "\n")
    (tmp_path / "4").write_text("1 2\n\n3\n")
    size = (tmp_path / "3").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 3))
    try:
        assert corpus._lines(spark, str(tmp_path / "3")).select("block").distinct().count() >= 3
        got = rows(corpus.scores(spark, str(tmp_path)).where("question_id = 3"), "owner_id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    words = " ".join(lines).split()
    assert [r[1] for r in got] == list(range(len(words)))
    assert [round(r[2], 3) for r in got] == [round(float(w), 3) for w in words]
    assert rows(corpus.scores(spark, str(tmp_path)).where("question_id = 4"), "owner_id") == [(4, 0, 1.0), (4, 1, 2.0), (4, 2, 3.0)]


def test_raw_tree(spark, tmp_path):
    for k, (name, grades) in enumerate({"11.10": "1 2\n", "11.2": "3\n", "2.1": "4\n\n5\n"}.items()):
        (tmp_path / "scores" / name).mkdir(parents=True)
        for grader in ("ave", "me", "other"):
            (tmp_path / "scores" / name / grader).write_text(grades if grader == "ave" else f"{k}\n")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "2.1").write_text("2.1 An  answer\n2.1\n")
    found = corpus.collected_tree(spark, str(tmp_path / "scores"))
    assert rows(found, "question_id", "owner_id") == [(0, 0, "2.1", 4.0), (0, 1, "2.1", 5.0), (1, 0, "11.2", 3.0), (2, 0, "11.10", 1.0), (2, 1, "11.10", 2.0)]
    assert corpus.raw_scores(spark, str(tmp_path / "scores")).where("grader = 'me'").count() == 3
    assert rows(corpus.collected_tree(spark, str(tmp_path / "scores"), exclude=("11.2",)), "question_id", "owner_id")[-1] == (1, 1, "11.10", 2.0)
    assert rows(corpus.raw_answers(spark, str(tmp_path / "raw")), "line") == [("2.1", 0, "An answer"), ("2.1", 1, "")]
