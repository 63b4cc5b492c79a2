from ferial.llm.sentences import split_sentences, with_sentences

CASES = {
    "Dr. Orth came at 6 a.m. and left. At 6 p.m. He stayed, etc. Then e.g. this.Shadow of J. T. Osbern in vol. IV. End": [
        "Dr. Orth came at 6 a.m. and left.", "At 6 p.m.", "He stayed, etc.", "Then e.g. this.", "Shadow of J. T. Osbern in vol. IV.", "End",
    ],
    "Heading\n\nIt is 3.5 cubits\nlong, cf. Ven. 4.21 here… and there?! Yes!\n \n(A. B c. D.) “One. Two,” said he. ‘It don’t. So?’ Next": [
        "Heading", "It is 3.5 cubits\nlong, cf. Ven. 4.21 here… and there?!", "Yes!", "(A. B c. D.)", "“One. Two,” said he.", "‘It don’t. So?’", "Next",
    ],
    'x "b. C" d. "E f." G': ['x "b. C" d.', '"E f."', "G"],
    "「答える約束。鐘。」と番人は言った。第4章No.17羊A.B.記も…。次！": ["「答える約束。鐘。」と番人は言った。", "第4章No.17羊A.B.記も…。", "次！"],
    "“高山。果园。”守门人说……。与“锚。”读？": ["“高山。果园。”守门人说……。", "与“锚。”读？"],
    "หอคอย 12 เตาไฟ และน้ำ ๆ ประตู พ.ศ. 2590 น้ำ เย็น“ใน”อด": ["หอคอย 12 เตาไฟ", "และน้ำ ๆ ประตู พ.ศ. 2590 น้ำ", "เย็น“ใน”อด"],
    "የይ ዓ.ም. 1950 ሸ። አለ: «ምሕረት። ዘይት።» ጸጥታ፧ «ሱፍ። ጥን», አለ።": ["የይ ዓ.ም. 1950 ሸ።", "አለ: «ምሕረት። ዘይት።»", "ጸጥታ፧", "«ሱፍ። ጥን», አለ።"],
    "رحمة 3.5 أذرع د. أورلين. قال: «ماء. عسل.» صحراء؟ نعم": ["رحمة 3.5 أذرع د. أورلين.", "قال: «ماء. عسل.»", "صحراء؟", "نعم"],
    "सं. 17 डॉ. ओर्लिन॥ पाठक: “सदा। रोटी।” घंटी! दया": ["सं. 17 डॉ. ओर्लिन॥", "पाठक: “सदा। रोटी।”", "घंटी!", "दया"],
    "Απαντά κεφ. 4 φυλάει; Νησί κ.λπ. και «Α. Β», είπε π.χ. σας. Αγ. Μαρ.": ["Απαντά κεφ. 4 φυλάει;", "Νησί κ.λπ. και «Α. Β», είπε π.χ. σας.", "Αγ. Μαρ."],
    "Que M. J. Mar miel ! « Calme. Désert. » Étroit p. ex. env. 3,5": ["Que M. J. Mar miel !", "« Calme. Désert. »", "Étroit p. ex. env. 3,5"],
    "am 3. Mai z. B. Tal d. h. „Fluss. Ernte.“ Berg Nr. 5": ["am 3. Mai z. B. Tal d. h. „Fluss. Ernte.“", "Berg Nr. 5"],
    "Соль т. е. и т. д. до А. Б. Мард. Св. гл. 4.": ["Соль т. е. и т. д. до А. Б. Мард.", "Св. гл. 4."],
    "¿Qué? ¡Sí! See https://a.example.org/x.html?y=1 now.": ["¿Qué?", "¡Sí!", "See https://a.example.org/x.html?y=1 now."],
    "He left in May. 12 men came. See Mar. 12 there.": ["He left in May.", "12 men came.", "See Mar. 12 there."],
    "(a. B": ["(a.", "B"],
    "...": ["..."],
    " \n ": [],
    "": [],
}


def test_units(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id int, text string")
    rows = with_sentences(df, "doc_id", "text").collect()
    for i, want in enumerate(CASES.values()):
        own = sorted((r.sent_no, r.sentence) for r in rows if r.doc_id == i)
        assert [s for _, s in own] == want, i
        assert [n for n, _ in own] == list(range(1, len(want) + 1))


def test_places_long_texts_and_edges(spark):
    long = "Ab c. " * 200_000 + "(" * 60_000 + "“. X" * 500 + "x, " * 100_000 + "…" * 50_000
    rows = [(1, long, "n"), (2, None, "n"), (3, "\n\n\n", "n"), (None, "A. B", "n")]
    df = spark.createDataFrame(rows, "doc_id int, text string, piece string")
    out = split_sentences(df, "doc_id", "text").collect()
    assert {r.doc_id for r in out} == {1, None}
    own = sorted((r.sent_no, r.sent_start, r.sent_end) for r in out if r.doc_id == 1)
    assert [n for n, _, _ in own] == list(range(1, len(own) + 1))
    assert own[:2] == [(1, 0, 5), (2, 6, 11)] and own[-1][2] == len(long)
    assert all(a[2] <= b[1] for a, b in zip(own, own[1:]))
    assert all(not long[a[2] : b[1]].strip() for a, b in zip(own, own[1:]))
    twice = spark.createDataFrame([(1, "A b. C d.")] * 3 + [(2, "E")], "doc_id int, text string")
    assert sorted(map(tuple, split_sentences(twice, "doc_id", "text").collect())) == [(1, 1, 0, 4), (1, 2, 5, 9), (2, 1, 0, 1)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0
