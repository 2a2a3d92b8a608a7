"""Stems against the published sample, full-text search against brute force."""

import itertools
import random
import uuid

import pytest

from tidewire.functions import stemming
from tidewire.operators import fulltext

# The sample vocabulary published with the algorithm.
SAMPLE = """che che checa chec checar chec checo chec checoslovaquia checoslovaqui chedraoui chedraoui chefs chefs cheliabinsk cheliabinsk chelo chel chemical chemical chemicalweek chemicalweek chemise chemis
chepo chep cheque chequ chequeo cheque cheques chequ cheraw cheraw chesca chesc chester chest chetumal chetumal chetumaleños chetumaleñ chevrolet chevrolet cheyene cheyen cheyenne cheyenn chi chi chía chi
chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican chicas chic chicharrones chicharron chichen chich chichimecas chichimec chicles chicl chico chic
torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment tormentas torment tornado torn
tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped torpeza torpez torrado torr
torralba torralb torre torr torrencial torrencial torrenciales torrencial torrente torrent torreon torreon torreón torreon torres torr torrescano torrescan""".split()


def test_stems_of_the_published_sample():
    for word, want in zip(SAMPLE[::2], SAMPLE[1::2], strict=True):
        assert stemming.stem(word) == want, word


@pytest.mark.parametrize("words,want", [("rápida rápido rápidos", "rap"), ("nacionalidades nacional", "nacional"), ("biología biologías", "biolog"), ("pague paguen", "pag"), ("distribuyendo distribuyó", "distribu"), ("amablemente amable", "amabl"), ("significativamente significativa", "signific"), ("a", "a"), ("", ""), ("ñ", "ñ")])
def test_stems_of_one_family(words, want):
    assert {stemming.stem(w) for w in words.split(" ")} == {want}


def test_stop_words():
    for w in "la el estuviésemos habríais fueron tendremos siendo habidas también".split():
        assert w in stemming.STOP_WORDS
    assert not {"agua", "corte", "ser", ""} & stemming.STOP_WORDS


def test_stems_column(spark, monkeypatch):
    monkeypatch.setattr(stemming, "MAX_WORDS", 2)
    df = spark.createDataFrame([(["los", "cortes", None, "agua"],), ([],), (None,), (["cortes", "cortes", "x", "y", "z"],)], "w array<string>")
    got = [r[0] for r in df.select(stemming.stems(df["w"])).collect()]
    assert got == [["cort", "agu"], [], None, ["cort", "cort", "x", "z"]]  # y is a stop word
    assert df.select(stemming.stems(df["w"], stop=[])).first()[0] == ["los", "cort", "agu"]


def brute_rank(words, stems):
    """Every stretch that holds all stems and no shorter one that does."""
    known = stemming.Stems()
    at = [(i, known[w]) for i, w in enumerate(words) if known[w] in stems]
    holds = [(s, e) for s, e in itertools.combinations_with_replacement(range(len(at)), 2) if {x for _, x in at[s : e + 1]} == set(stems)]
    covers = [(s, e) for s, e in holds if not any((a, b) != (s, e) and s <= a and b <= e for a, b in holds)]
    return sum(0.1 / (1 + (at[e][0] - at[s][0]) - (e - s)) for s, e in covers) if covers else None


@pytest.fixture
def path(tmp_path):
    return (tmp_path / uuid.uuid4().hex).as_uri()


def test_search_against_brute_force(spark, path):
    r = random.Random(4)
    pick = lambda n: " ".join(r.choice(["corte", "Cortes", "agua", "aguas", "lima", "la", "del", "zona", "x"]) for _ in range(n))
    texts = {i: pick(r.randint(0, 40)) for i in range(80)} | {90: None, 91: "", 92: "la de el", 93: "¡AGUA!corte,lima", 94: "agua corte " * 15}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    fulltext.write_index(df, "id", "text", path, buckets=4)
    for question in ("agua", "el corte del agua", "cortes de aguas en Lima", "zonas"):
        stems = fulltext.query_stems(question)
        want = {i: brute_rank(fulltext._WORD.findall((t or "").lower()), stems) for i, t in texts.items()}
        want = sorted(((i, round(x, 6)) for i, x in want.items() if x), key=lambda x: (-x[1], x[0]))
        got = [tuple(x) for x in fulltext.search(spark, path, question, 1000, buckets=4).collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=True))
    assert fulltext.search(spark, path, "de la", 5, buckets=4).count() == 0
    assert fulltext.search(spark, path, "nunca visto", 5, buckets=4).count() == 0


def test_search_reads_its_own_postings_alone(spark, path):
    df = spark.createDataFrame([(i, f"palabra{i % 50} corte de agua {i}") for i in range(200)], "id long, text string")
    fulltext.write_index(df, "id", "text", path)
    plan = fulltext.search(spark, path, "palabra7 y cortes", 5)._jdf.queryExecution().toString()
    buckets = sorted({fulltext.bucket_of(s, fulltext.BUCKETS) for s in ("palabra7", "cort")})
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"bucket#{plan.split('bucket#')[1].split(' ')[0]} IN ({','.join(map(str, buckets))})" in plan
    assert "PushedFilters: [In(stem, [cort,palabra7])" in plan
    read = fulltext.read_postings(spark, path, ["palabra7"])
    assert len(read.inputFiles()) > 0 and read.count() == 4
    assert {r["doc"] for r in fulltext.search(spark, path, "palabra7 y cortes", 5).collect()} == {7, 57, 107, 157}


def test_index_takes_days_as_they_come(spark, path):
    day = lambda rows: spark.createDataFrame(rows, "id long, text string, stem int, doc int, at int")
    fulltext.write_index(day([(1, "agua", 1, 2, 3), (None, "agua", 1, 2, 3)]), "id", "text", path)
    fulltext.write_index(day([(2, "agua y más agua", 1, 2, 3), (1, "corte", 1, 2, 3)]), "id", "text", path, append=True)
    assert [tuple(x) for x in fulltext.search(spark, path, "agua", 5).collect()] == [(2, 0.2), (1, 0.1)]
    assert [x["doc"] for x in fulltext.search(spark, path, "agua corte", 5).collect()] == [1]
    figures = {r["stem"]: (r["n_docs"], r["n_occurrences"]) for r in fulltext.stem_figures(spark, path).collect()}
    assert figures == {"agu": (2, 3), "cort": (1, 1)}  # más is a stop word


def test_empty_index(spark, path):
    fulltext.write_index(spark.createDataFrame([], "id long, text string"), "id", "text", path)
    assert fulltext.postings(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_figures_count_documents_of_several_rows_once(spark, tmp_path, monkeypatch):
    """Rows of one id are one document, in one segment or several; what is put together by document is theirs alone."""
    rows = spark.createDataFrame([(1, "agua agua luz"), (2, "agua"), (1, "agua gas"), (3, ""), (4, None)], "i long, t string")
    path = fulltext.write_index(rows.coalesce(1), "i", "t", str(tmp_path / "x"))
    fulltext.write_index(spark.createDataFrame([(2, "luz agua"), (5, "gas")], "i long, t string"), "i", "t", path, append=True)
    held, given = [], fulltext.kept
    monkeypatch.setattr(fulltext, "kept", lambda df: held.append(given(df)) or held[-1])
    stem = lambda w: fulltext.query_stems(w)[0]
    assert {tuple(r) for r in fulltext.stem_figures(spark, path).collect()} == {(stem("agua"), 2, 5), (stem("luz"), 2, 2), (stem("gas"), 2, 2)}
    assert sorted(r["doc"] for r in held[0].collect()) == [1, 2]
