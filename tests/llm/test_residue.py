import pytest
from pyspark.sql import functions as F

from seqloom.llm.residue import evidence, normal
from seqloom.llm.templates import by_evidence, judge, profile, residue, without_residue

NAMES = ["user", "order.total", "SOURCE_CHAIN", "first_name"]
SHAPES = [
    "{{%s}}", "{{ %s }}", "{{{%s}}}", "${%s}", "#{%s}", "{$%s}", "{%% %s %%}", "<%%= %s %%>", "$%s$", "%%%s%%", "@@%s@@", "__%s__", "##%s##", "*|%s|*", "«%s»", "&%s;", "XXX %s XXX", ":%s:", "[[%s]]", "[%s]", "[INSERT %s]", "[your %s here]",
    "[%s to be added]", "(%s TBD)", "<insert %s>", "<%s>", "{%s}", "<%s hier>", "<%s aquí>", "<%s ici>", "[%s einfügen]", "[insertar %s]", "[insérer %s]", "[请输入%s]", "【此处填写%s】",
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("name", NAMES)
def test_placeholders_in_own_voice_and_in_mentions(shape, name):
    p = shape % name
    assert evidence(normal(f"The watcher of {p} raised the fee to 5 units.")), p
    for mention in (f"The letter uses `{p}` here.", f'The field "{p}" is filled in later.', f"Das Feld „{p}“ füllt der Versand.", f"```\nrender {p}\n```\nNothing more to say."):
        assert not evidence(normal(mention)), mention


@pytest.mark.parametrize("mark", ["undefined", "null", "NaN", "TBD", "TODO", "???", "________", "%s", "%d", "#REF!", "[object Object]", "XX.XX.XXXX", "{0}"])
def test_marks_of_missing_values(mark):
    assert evidence(normal(f"Gas on {mark} climbed to 52 units."))
    assert not evidence(normal(f'The word "{mark}" in the contract marks open points.'))


@pytest.mark.parametrize(
    "text",
    [
        "Lorem ipsum dolora sedu.", "Content coming soon.", "Your text goes here.", "Add a description for this block.", "jkl; jkl; jkl; jkl; jkl; jkl;", "此处填写正文。", "Hier steht später Ihr Text.", "Texto de relleno para el diseño.", "Votre texte ici.",
        "HTTP 504 - Gateway Timeout", "Error 404: Not Found", "Oops! That page is gone.", "Session expired. Log in again.", "No upstream is healthy.", '{"error": {"code": 404, "message": "not found", "request": "0x9"}}', "<html><head><title>503 Service Unavailable</title></head></html>",
        'Warning: query failed: relation "a" does not exist in /srv/a/view.php on line 9', "Unhandled TimeoutError: date\n  at a.b.load(c.kt:7)", "服务暂时不可用，请稍后再试。", "Zugriff verweigert.", "Página no encontrada.", "Page introuvable",
        "<noscript>Needs JS</noscript>", "Kindly allow JS and reload.", "本浏览器已禁用脚本，无法显示内容。", "Ihr Browser blockiert Skripte.", "El panel no funciona sin scripts.", "Activez JavaScript pour afficher cette page.", "JavaScript and cookies are needed.",
    ],
)
def test_residue_alone_and_as_a_section(text):
    assert evidence(normal(text))
    assert evidence(normal(f"# Bridge / Chain #7\n\nNo funds were lost.\n\n{text}\n\n-- someone"))


@pytest.mark.parametrize(
    "text",
    [
        "", "...!!!???", "Ã¤Ã¶ broken �� text", "<s> [SEP] text <|endoftext|>", "The word TODO in the contract marks 7 open points.", "The parser once turned a missing amount into undefined, and 7 texts showed that word instead of a number.",
        'Is a blank page with "access denied" an outage?', "When a browser has scripts switched off, the explorer shows nothing but a notice, and users took that for an outage.", "Wer JavaScript sperrt, sieht im Explorer nichts.",
        "The release note was drafted over lorem ipsum, and the operator replaced the filler before it went out.", "The old status page answered with 500 internal server error for 53 h, which hid the backlog.", "状态页在 12:34 返回了 110 次 404，之后恢复正常。",
        "SRC tx=0x1 to=A amount=5; LOCK{tx:0x2; to:B}", "Set `export RELAY_URL=${HOST}/v1` and restart.", "La página dio error 429 durante 5 s y luego volvió.", "[09:12] user: all fine", "Costs $5 and 50% of 20%.",
    ],
)
def test_texts_that_only_talk_about_it(text):
    assert not evidence(normal(text))


def test_disguise_does_not_hide():
    assert evidence(normal("Соntent c​oming sооn."))


def test_tables(spark):
    shell = "Menu  Explorer  Blog\n\nLoading item {}"
    data = [(1, "Page introuvable", "a"), (2, "All is well here.", "a"), (3, None, None), (4, "", "a"), (5, " ?! ", "b"), (2, "All is well here.", "a"), (None, "Content coming soon.", "b"), (6, "word " * 30_000 + "\nOops!\n", None)]
    data += [(10 + i, shell.format(i), h) for i, h in enumerate(["a", "b", None, "c"])] + [(20, "Loading only once, elsewhere", "a")]
    df = spark.createDataFrame([(*r, "slug", "x") for r in data], "doc_id long, text string, source string, bridge string, kinds string").repartition(3)
    found = {r.id for r in residue(df, "doc_id", "text", "source", ("bridge",)).collect()}
    assert found == {1, None, 6, 10, 11, 12, 13}
    for most in (10, 0):  # repeated shapes by broadcast, by join
        kept = [r.id for r in without_residue(df, "doc_id", "text", "source", ("bridge",), most=most).collect()]
        assert sorted(kept) == [2, 2, 3, 4, 5, 20]
    assert residue(df.limit(0), "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize("text", ["Eufugi velita culpam nostrudo dolora duisa. Veniam.", "Pariatu magnam occaeca velita laborin desera.", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus.", "Dolorém ullamco nisia.", "Contenido pendiente. Contenido pendiente."])
def test_latin_filler_without_lorem(text):
    assert evidence(normal(text)).get("filler")
    assert evidence(normal(f"# Bridge / Chain #7\n\nNo funds were lost.\n\n{text}\n\n-- someone")).get("filler")


@pytest.mark.parametrize("text", ["El error de la página no está pendiente.", "Labor, elite officials and temporary exceptions.", "Name, site, nullable, under, auto, tells.", "The cursor of the animal site met an error in just one name."])
def test_latin_looking_words_are_no_filler(text):
    assert not evidence(normal(text))


@pytest.mark.parametrize("text", ["Nobody could say why Yuandca received TBD OST when the lock named another recipient.", "Nobody could say why ??? received 820 TRN when the lock named another recipient.", "The second column shows that null was paid to the field office.", "In other words, the fee turned out to be NaN for a week."])
def test_marks_beside_unrelated_words(text):
    assert evidence(normal(text)).get("mark")


@pytest.mark.parametrize("text", ["THE WORD TODO IN THE CONTRACT OF X MARKS 7 OPEN POINTS.", "The column named TBD was dropped.", "There TBD means that nobody has decided.", "The parser wrote 0 instead of null for a month.", "The null field was dropped."])
def test_marks_that_a_sentence_names(text):
    assert not evidence(normal(text))


def test_comparison_of_slug_title_and_body():
    p = profile("# Wex / Ruo #7\n\nThe keeper of Wex saw 5 locks.", "site Wex")
    assert (p.terms, p.shared, p.furniture) == (7, 1, False)
    assert profile("The keeper of Anb saw 12 locks.", "site").shape == profile("The keeper of Wex saw 5 locks.", "site").shape
    assert profile("Wex 5", "Wex").shape is None and profile("", "").shape is None


def test_host_evidence_joins_detectors_and_shapes(spark):
    bar = " ---- ~~ ----"
    data = [(1, "Title goes here.", "a"), (2, "Title goes here", "b"), (3, "Title goes here" + bar, "b"), (4, "Title goes there" + bar, "b")]
    data += [(10 + i, f"Loading {n} view", h) for i, (n, h) in enumerate([("of Anb", "a"), ("of Wex", "b"), ("of Ruo", None)])]  # shells that name different sites
    data += [(20 + i, f"The nonce jumped by {i}, so {n} ignored it.", h) for i, (n, h) in enumerate([("Anb", "a"), ("Wex", "b"), ("Ruo", "c")])]  # content repeats, too
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    assert {r.id for r in residue(df, "doc_id", "text", "source").collect()} == {1, 2, 3, 10, 11, 12}
    for most in (10, 0):
        assert sorted(r.id for r in without_residue(df, "doc_id", "text", "source", most=most).collect()) == [4, 20, 21, 22]


@pytest.mark.parametrize("text", ["jkl; " * 500, "x" * 3000, "Pariatu magnam occaeca velita laborin desera " * 40, "text goes here " * 60, "The watcher of {{" + "long_variable_name_" * 20 + "}} raised the fee.", "Warning: query failed: " + "a" * 900])
def test_no_bound_on_length(text):
    assert evidence(normal(text))


@pytest.mark.parametrize("text", ["word " * 30_000, "x" * 30_000 + "y", "text goes " * 3_000 + "away", "." * 30_000 + " id", "jkl; " * 6_000 + "z", "{{" + "a" * 30_000, "$a" * 15_000, "error 404 " * 3_000 + "rose"])
def test_long_sentences_take_linear_time(text):
    import time

    start = time.process_time()
    evidence(normal(text))
    assert time.process_time() - start < 5


def _documents(spark):
    long = "The keeper of {} saw {} locks wait. Every relay of {} keeps a ledger that nobody reads."
    data = [(i, "The harbour lies still tonight", h) for i, h in enumerate("abc")]  # unknown to the detectors, whole body
    data += [(3 + i, long.format(n, i, n) + "\n\nThe harbour lies still tonight", h) for i, (n, h) in enumerate([("Anb", "a"), ("Wex", "d")])]  # the same as a section
    data += [(10 + i, long.format(n, i, n) + "\n\nAlways compare both legs before release", h) for i, (n, h) in enumerate([("Anb", "a"), ("Wex", "b"), ("Ruo", "c")])]  # repeated, never alone
    data += [(20 + i, "Ledger of the keeper", "a") for i in range(5)]  # one host only
    data += [(30 + i, f"Fees on {n} rose to {i} units.", h) for i, (n, h) in enumerate([("Anb", "a"), ("Wex", "b"), ("Ruo", "c")])]
    data += [(40, "Fees on {{chain}} rose to 7 units.", "a"), (41, "Here TBD means that nobody has decided.", "b")]
    data += [(50 + i, f"In {n} the column named {x} was dropped.", h) for i, (n, x, h) in enumerate([("Anb", 1, "a"), ("Wex", 2, "b"), ("Ruo", "TBD", "c"), ("Kop", 4, "c")])]
    return spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)


def test_mismatched_repeated_sentences_need_no_detector(spark):
    df = _documents(spark)
    found = {r.id: r.kinds for r in residue(df, "doc_id", "text", "source").collect()}
    assert {i: k for i, k in found.items() if i < 30} == {i: ["response"] for i in range(5)}
    assert found[40] == ["placeholder", "slot"] and 41 not in found
    assert found[52] == ["slot"]  # its place is filled elsewhere, so the mark isn't discussed
    assert set(found) == {0, 1, 2, 3, 4, 40, 52}
    for most in (100, 0):
        kept = {r.id for r in without_residue(df, "doc_id", "text", "source", most=most).collect()}
        assert kept == {r.doc_id for r in df.collect()} - set(found)
    assert {tuple(r) for r in by_evidence(residue(df, "doc_id", "text", "source")).collect()} == {("response", 5, 5), ("slot", 2, 1), ("placeholder", 1, 0)}


def test_terms_are_compared_with_slug_title_and_other_sentences():
    low = lambda text, slug: judge(text, slug).bits
    assert low("Nothing moves here today", "site") == [1]
    assert low("Nothing moves here today", "site nothing") == []  # a word of the slug names something
    assert low("# Nothing\n\nNothing moves here today", "") == []
    assert low("Nothing moves here today. Some days nothing helps", "") == [0, 0]
    assert low("拒绝访问", "") == [3] and low("Page introuvable", "") == [3]
    assert judge("Nothing moves here today", "").alone and not judge("Nothing moves here today. Gas rose to 52 units on Wex.", "").alone
    assert judge(None, "") == judge("", "") and not judge(" ?! ", "").alone


@pytest.mark.parametrize("text", ["asdfasdfasdfasdf", "Title goes here --------"])
def test_runs_of_keys_and_trailing_dashes(text):
    assert evidence(normal(text)).get("filler")


def test_empty_tables_and_clashing_columns(spark):
    df = _documents(spark).withColumns({c: F.lit("clash") for c in ("shape", "low", "bits", "uid", "host", "slug", "claim", "kind")})
    empty = df.limit(0)
    assert residue(empty, "doc_id", "text", "source").count() == by_evidence(residue(empty, "doc_id", "text", "source")).count() == 0
    for most in (100, 0):
        assert without_residue(empty, "doc_id", "text", "source", most=most).count() == 0
    assert {r.id for r in residue(df, "doc_id", "text", "source", ("host",)).collect()} == {0, 1, 2, 3, 4, 40, 52}


def test_a_hot_host_and_a_hot_text_change_nothing(spark):
    hot = [(1000 + i, "The gate is shut today", "hot") for i in range(400)] + [(2000 + i, "Fees rose on {{chain}} again.", "hot") for i in range(300)]
    df = _documents(spark).unionByName(spark.createDataFrame(hot, "doc_id long, text string, source string"))
    assert {r.id for r in residue(df, "doc_id", "text", "source").collect()} == {0, 1, 2, 3, 4, 40, 52, *range(2000, 2300)}
