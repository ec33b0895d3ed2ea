import pytest

from inkloom.llm import pii

GIVEN, FAMILY = ["דנה", "יואב", "שיר", "Dalia", "נועה"], ["כרמפומרי", "זלטזודה", "ורנטשטרון", "Tolomberg", "קנדשטרון"]


def template(around):
    tokens = around.split()
    return pii.template(around), pii.shape(tokens, next(i for i, t in enumerate(tokens) if t.endswith("_")))


@pytest.fixture(scope="module")
def finder(classes):
    known = pii.Known(given={x.lower() for x in GIVEN}, family={x.lower() for x in FAMILY}, templates=dict(map(template, ("_", "dear _ ,", "ל_ שלום ,", "חתום : _"))), streets={"הזית", "נחל הקנים"}, towns={"תל אשכול"})
    return pii.Finder(known), pii.Folding(classes)


CASES = [
    ("כתבו לreed-quill@daf.invalid מהר", [("email", "reed-quill@daf.invalid")]),
    ("mailto:a.b+c9 [at] mail [dot] example", [("email", "a.b+c9 [at] mail [dot] example")]),
    ("x_y @ post.example.org.", [("email", "x_y @ post.example.org")]),
    ("a-b שטרודל kita.example.net", [("email", "a-b שטרודל kita.example.net")]),
    ("tinker４４＠archive．test", [("email", "tinker４４＠archive．test")]),
    ("Meet at noon @ the mill. It cost 3 @ 139 each. כתבו ב@לוח_המודעות", []),
    ("טל' 053-55-511-77, או (04) 555-0938", [("phone", "053-55-511-77"), ("phone", "(04) 555-0938")]),
    ("+972 50 5550046 00972-58-5550702 +44 7700 900 991 (202) 555-0175", [("phone", "+972 50 5550046"), ("phone", "00972-58-5550702"), ("phone", "+44 7700 900 991"), ("phone", "(202) 555-0175")]),
    ("ת.ז. 77771676-2; 99 615 6378; 772-267-191 66340147 9", [("idnum", "77771676-2"), ("idnum", "99 615 6378"), ("idnum", "772-267-191"), ("idnum", "66340147 9")]),
    ("Form 224351483, מס' רישום 842245344, ברקוד 7290704704704, תיק 497/5551, Box 723-723-723", []),
    ("גרנו ברח' הזית 12/28, תל אשכול.", [("address", "רח' הזית 12/28, תל אשכול")]),
    ("שדרות נחל הקנים 18 דירה 2", [("address", "שדרות נחל הקנים 18 דירה 2")]),
    ("מען: הזית 25, תל אשכול 1234567 ;", [("address", "הזית 25, תל אשכול 1234567")]),
    ("רחוב הזית 40, תל אשכול, 00972-50-5559942", [("phone", "00972-50-5559942"), ("address", "רחוב הזית 40, תל אשכול")]),
    ("13 Fig Road, 07700 900040; סמטת הזית 4, דנה כרמפומרי", [("address", "13 Fig Road"), ("phone", "07700 900040"), ("address", "סמטת הזית 4"), ("name", "דנה כרמפומרי")]),
    ("at Flat 9, 55 Old Well Road, x. 13 Fig St. Lane 321 of the list", [("address", "Flat 9, 55 Old Well Road"), ("address", "13 Fig St.")]),
    ("ברחוב הזית פרחו עצים. בכיכר הטבחית ניקתה 35 זית. אכלנו הזית 5 פעמים", []),
    ("מסרתי לגב' דנה כרמפומרי-זלטזודה את", [("name", "דנה כרמפומרי-זלטזודה")]),
    ("קנדשטרון נועה ויואב זלטזודה", [("name", "קנדשטרון נועה"), ("name", "יואב זלטזודה")]),
    ("מכתב מל' כרמפומרי, דנה שיר ורנטשטרון; Y. Tolomberg, לH. Tolomberg", [("name", "ל' כרמפומרי"), ("name", "דנה שיר ורנטשטרון"), ("name", "Y. Tolomberg"), ("name", "H. Tolomberg")]),
    ("ד׳ כר‏מפ­ומרי", [("name", "ד׳ כר‏מפ­ומרי")]),
    ("לנועה שלום,\nשיר ישן על אור.\nDear Dalia,\nחתום: יואב\nדנה", [("name", "נועה"), ("name", "Dalia"), ("name", "יואב"), ("name", "דנה")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(finder, text, want):
    find, folding = finder
    folded, places = pii.fold(folding, text)
    assert folded == pii.folded(folding, text)
    places = places or list(range(len(text)))
    got = [(k, text[places[a] : places[b - 1] + 1]) for k, a, b in find.find(folded)]
    assert sorted(got) == sorted(want)


def test_check_digit():
    assert pii.check_digit("777716762") and not pii.check_digit("777716763")
    assert sum(pii.check_digit("12345678" + str(d)) for d in range(10)) == 1


FRAMES = ["פגשתי את {} בדרך.", "המחברת שייכת ל{}.", "קיבלתי מכתב מ{} השבוע.", "הרב {} קרא את השורה.", "({}) הוסיף הערה."]
UNSEEN_GIVEN, UNSEEN_FAMILY = ["רונית", "גל"], ["טולבאשני", "ברנהודאי"]


def corpus():
    given, family = GIVEN + UNSEEN_GIVEN, FAMILY + UNSEEN_FAMILY
    texts, names = [], 0
    for i, g in enumerate(given):
        for j, f in enumerate(family):
            for k, frame in enumerate(FRAMES):
                texts.append(frame.format(f"{g} {f}" if (i + j + k) % 4 else f"{f} {g}") + "\nראינו גל גבוה. שיר ישן על אור.")
                names += 1
    for g in given:
        texts.append(f"חתום: {g}\n{g}")
        names += 2
    return texts, names


def test_bootstrapping_finds_unseen_names(spark, classes):
    texts, names = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, "", " ", "a" * 100_000])], "doc_id bigint, text string, word string")
    seeds = spark.createDataFrame([(g, "given", "he") for g in GIVEN] + [(f, "family", "he") for f in FAMILY] + [(None, "given", "he")], "name_text string, name_role string, lang string")
    known, folding = pii.learn(spark, docs, seeds, classes)
    assert {*UNSEEN_GIVEN} <= known.given and {*UNSEEN_FAMILY} <= known.family
    assert known.given == {x.lower() for x in GIVEN + UNSEEN_GIVEN} and known.family == {x.lower() for x in FAMILY + UNSEEN_FAMILY}
    found = pii.identifiers(docs, known, folding).collect()
    assert len(found) == names and {r.pii_kind for r in found} == {"name"}
    clean = {r.doc_id: r.text for r in pii.redacted(docs, known, folding).collect()}
    assert clean[0].startswith("פגשתי את [NAME] בדרך.") and clean[len(texts)] is None and clean[len(texts) + 1] == "" and clean[len(texts) + 3] == "a" * 100_000


def test_without_names_and_texts(spark, classes):
    docs = spark.createDataFrame([(1, "נייד 0535554417"), (1, "נייד 0535554417")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "name_text string, name_role string")
    known, folding = pii.learn(spark, docs, none, classes)
    assert [tuple(r) for r in pii.identifiers(docs, known, folding).collect()] == [(1, "phone", 5, 15)] * 2
    known, folding = pii.learn(spark, docs.limit(0), none, classes)
    assert pii.identifiers(docs.limit(0), known, folding).count() == 0


def test_labels_find_and_reject_numbers(spark, classes):
    # behind "extension" nearly all numbers are phone numbers, behind "register" nine digits pass the check digit by chance only
    texts = [f"extension 050-55{k:02}-{k:03}" for k in range(60)] + [f"register {100000000 + 7919 * k}" for k in range(200)]
    texts += ["extension 9-123-4567-89", "register 777716762", "identity 777716762", "kilo 9-123-4567-89"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known, folding = pii.learn(spark, docs, spark.createDataFrame([], "name_text string, name_role string"), classes)
    assert known.phone_labels == {"extension"} and known.no_id_labels == {"register"}
    got = {(r.doc_id, r.pii_kind) for r in pii.identifiers(docs, known, folding).collect()}
    n = len(texts)
    assert got == {(k, "phone") for k in range(60)} | {(n - 4, "phone"), (n - 2, "idnum")}


def test_lines_of_any_length_have_templates(spark, classes):
    # a long opening that many letters share tells a lone given name, and a name learned only in a second round is found by it
    opening = "to my very dear and much missed old friend {} who never answers letters any more whatever one writes to them"
    texts = [opening.format(g.lower()) for g in GIVEN + UNSEEN_GIVEN] + corpus()[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seeds = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "name_text string, name_role string")
    known, folding = pii.learn(spark, docs, seeds, classes)
    found = {r.doc_id for r in pii.identifiers(docs, known, folding).collect() if r.doc_id < len(GIVEN + UNSEEN_GIVEN)}
    assert found == set(range(len(GIVEN + UNSEEN_GIVEN)))


def test_many_streets_cost_one_pass(classes):
    import time

    streets = {f"רחו{chr(1488 + k % 20)}{chr(1488 + k // 20 % 20)}{chr(1488 + k // 400 % 20)}{chr(1488 + k // 8000 % 20)} {chr(1488 + k // 160000 % 20)}ן" for k in range(1_000_000)} | {"הזית"}
    finder = pii.Finder(pii.Known(streets=streets, towns={f"עיר {k}" for k in range(100_000)} | {"תל אשכול"}))
    text = "מען: הזית 25, תל אשכול " + "אבג דהו " * 20_000
    began = time.perf_counter()
    assert [k for k, _, _ in finder.find(text)] == ["address"]
    assert time.perf_counter() - began < 5
