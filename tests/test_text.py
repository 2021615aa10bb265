from pyspark.sql import functions as F

from noteloom.functions import scoring, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, "Caché x_1, b", text.tokens) == ["caché", "x_1", "b"]
    assert one(spark, "設計a文", text.tokens) == ["設計a文", "設計", "計文"]
    assert one(spark, "字", text.tokens) == ["字"]
    assert one(spark, "", text.tokens) == []
    assert one(spark, None, text.tokens) is None


def test_links_and_snippet(spark):
    assert one(spark, "a [[B]] [[c d|x]] [[]] [e]", text.wikilinks) == ["B", "c d"]
    assert one(spark, "# head\n\n--- rule\n  first line  \nnext", text.snippet) == "first line"
    assert one(spark, "# only", text.snippet) == ""
    assert one(spark, None, text.snippet) == ""
    assert one(spark, "[[A|b]]", text.unbracketed) == "A|b"


def test_name_tokens(spark):
    cases = {"CodeIndexer": {"code", "indexer"}, "HTTPServerPool": {"http", "server", "pool"}, "wiki-linker-design-v2": {"wiki", "linker", "design"}, "to_id": set(), "設計": set()}
    for name, want in cases.items():
        assert set(one(spark, name, text.name_tokens)) == want


def test_containment(spark):
    rows = spark.createDataFrame([(2, 3, 2), (1, 2, 4), (0, 2, 2), (0, 0, 2)], "s int, a int, b int")
    got = [r[0] for r in rows.select(text.max_containment(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0]


def test_prompts(spark):
    raw = "<channel a='b'>what  was\nsaid</channel><system-reminder>hidden\n</system-reminder>"
    assert one(spark, raw, text.clean_prompt) == "what was said"
    assert one(spark, None, text.clean_prompt) == ""
    assert one(spark, "/compact the rest", text.prompt_passes) is False
    assert one(spark, "short", text.prompt_passes) is False
    assert one(spark, "long enough words", text.prompt_passes) is True


def test_decisions(spark):
    cases = {"git commit -m x": "commit", "git -C /r push": "push", "docker compose up": "deploy", "kubectl apply -f a": "deploy", "ls": None}
    for command, want in cases.items():
        assert one(spark, command, text.decision_kind) == want


def test_small_helpers(spark):
    assert one(spark, "a/b/c.md", text.path_category) == "b"
    assert one(spark, "c.md", text.path_category) == "root"
    assert one(spark, "a b/c", text.safe_session) == "a_b_c"
    assert one(spark, None, text.safe_session) == "unknown"
    assert one(spark, "## head\nbody  of\ntext", text.recall_snippet) == "body of text"
    assert text.model_version("p", "m", 8) == "p-m-d8"
    assert text.like_escaped("a%_\\") == "a\\%\\_\\\\"
    assert len(one(spark, "x", text.file_hash)) == 16


def test_decay(spark):
    ages = [one(spark, a, lambda x: scoring.decay_factor(x, F.lit(0.003)), "double") for a in (0.0, -5.0, 10_000.0)]
    assert ages[:2] == [1.0, 1.0] and abs(ages[2] - 0.5) < 1e-9


def test_lambda(spark):
    rows = spark.createDataFrame([("a", "failures"), ("e", "x"), ("b", "x"), ("c", "slow")], "c string, k string")
    lam = scoring.lambda_for(F.col("c"), F.col("k"), ratios={"slow": 0.5}, evergreen=("e",))
    assert [r[0] for r in rows.select(lam).collect()] == [0.0, 0.0, 0.003, 0.0015]


def test_intent(spark):
    def name(t):
        n, c = scoring.intent(F.lit(t))
        return tuple(spark.range(1).select(n, c).first())

    assert name("這個類別在哪裡定義")[0] == "location"
    assert name("timeout error 怎麼解決") == ("failure", 1.0)
    assert name("hello") == ("default", 0.0)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(scoring.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1) < 1e-12 and got[2] is None
