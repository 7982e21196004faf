"""Problem 9."""

from lodestrand.llm import pii


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pii.pieces(text)]


def test_emails():
    for text, want in [
        ("mailto:a.b+c@dev.example.org.", "a.b+c@dev.example.org"), ("请联系bob_1@mail.example获取", "bob_1@mail.example"), ("<x (at) north (dot) example (dot) com>", "x (at) north (dot) example (dot) com"),
        ("see jo[at]relay.invalid now", "jo[at]relay.invalid"), ("mailto:w+t AT team-seven DOT example", "w+t AT team-seven DOT example"), ("author=A.B@CORP.EXAMPLE;pass=2", "A.B@CORP.EXAMPLE"),
    ]:
        assert kinds(text) == [("email", want)]
    for text in ("memcpy@plt", "handle@@VERS_2.41", "@taintvar n", "node#1@2", "@@ -1,7 +1,9 @@", "wraps at 0x12.ab"):
        assert kinds(text) == []


def test_phones():
    for number in ("+1 415 555 0160", "+14155550160", "1-312-555-0189", "(503) 555-0111", "201-555-0151", "415.555.0152", "+44 20 7946 0142", "+447700900595", "020 7946 0386", "07700 900950",
                   "+61 491 570 156", "+86 21 1555 0105", "010 15550859", "010-1555-0127", "(0755) 15550667", "０１０-１５５５-０１０７", "(030) 23 125 711", "0049 (0)30 23125516", "+49 30 23125-502", "030 23125 562"):
        assert kinds(f"电话：{number}。") == [("phone", number)], number
        assert kinds(f"call {number} ext. 12") == [("phone", number)], number
    for text in ("task 2024-0234-0769 was requeued", "range 347-945-347945", "seq 4591724591720", "version 10.335.73.2", "ticks=17353652551", "offsets 555-357-346 in", "build 20250241.903", "0x7f0002000099", "1_000_000,00"):
        assert kinds(text) == [], text


def test_identity():
    for text, want in [
        ("ssn=926-12-4894", "926-12-4894"), ("SSN 912 11 2010.", "912 11 2010"), ("NI no. QQ 08 48 41 D is", "QQ 08 48 41 D"), ("QQ851023D is in", "QQ851023D"), ("Passport: X38057226", "X38057226"),
        ("身份证号：99381019850610171X", "99381019850610171X"), ("Steuer-ID 04205385412", "04205385412"), ("Kennnummer: 06 900 885 276", "06 900 885 276"),
    ]:
        assert kinds(text) == [("identity", want)]


def test_addresses():
    for text, want in [
        ("He lives at 5673 Heronmere St..", "5673 Heronmere St"), ("寄往19 N. Oak Street。", "19 N. Oak Street"), ("Address: 23A Fallowwick Court, Flat 3, Eastfell", "23A Fallowwick Court"),
        ("Anschrift: Am Kiesel 11", "Am Kiesel 11"), ("wohnhaft Mühlgrundstr. 81", "Mühlgrundstr. 81"), ("an Brombeerweg 109a, Obersand", "Brombeerweg 109a"), ("办公室在 北岭大道364号，三楼", "北岭大道364号"), ("寄往青溪路631号。", "青溪路631号"),
    ]:
        assert kinds(text) == [("address", want)]
    assert kinds("Block Street is the name of test vector 145. Route Table Lane 92") == []


def test_names():
    for text, want in [
        ("I asked Petra O'Farrowby about this path.", "Petra O'Farrowby"), ("Reviewed-by: Esterley, Kasper", "Esterley, Kasper"), ("the patch by A. Immerhart moves", "A. Immerhart"), ("Dr. Dario A. Esterhart signed it off.", "Dario A. Esterhart"),
        ("Reviewed-by: TOBIAS KELTRABERG", "TOBIAS KELTRABERG"), ("Dr. leonie nordahley signed it off.", "leonie nordahley"), ("审核人：赵霁昕", "赵霁昕"), ("这条路径由Dario Nordahley负责", "Dario Nordahley"), ("这条路径由赵珞负责。", "赵珞"),
        ("assigned to Greta Ostrava-Lenz's queue", "Greta Ostrava-Lenz"), ("Felix McAldern says the guard is enough", "Felix McAldern"),
    ]:
        assert kinds(text) == [("name", want)]
    assert kinds("the Harlan Queue and the Tessel Ring are internal modules; the Orrin Buffer owner is unknown") == []


def test_redaction_keeps_the_rest():
    text = "Call +1 415 555 0160, then x@a.example!\r\n\t" + "z" * 100_000
    assert pii.redact(text) == "Call [PHONE], then [EMAIL]!\r\n\t" + "z" * 100_000
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact(" \n") == " \n"


def test_tables(spark):
    df = spark.createDataFrame([(1, "a@b.example a@b.example", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", "x")], "doc_id long, text string, pii_type string")
    assert [tuple(r) for r in pii.found(df).collect()] == [(1, "email", "a@b.example")]
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()} == {1: "[EMAIL] [EMAIL]", 2: None, 3: "", 4: "  "}
    assert pii.found(df.limit(0)).count() == 0


def test_long_pieces_are_whole():
    local, name = "a" * 90 + ".b", "Anne-" + "Marie-" * 30 + "Luise Schmidt"
    assert kinds(f"write to {local}@mail.example now") == [("email", f"{local}@mail.example")]
    assert kinds("x@" + "sub." * 100 + "example.org;") == [("email", "x@" + "sub." * 100 + "example.org")]
    assert kinds(f"Reviewed-by: {name}\n") == [("name", name)]
    assert kinds("Steuernummer " + "laut Bescheid " * 20 + "04205385412") == [("identity", "04205385412")]


def test_numbers_are_checked():
    for text in ("card 110105194912310021", "Build 078-05-1120", "SSN 000-12-3456 and 666-12-3456", "ssn=912-00-3456", "12 345 678 901 items", "GB123456A was built", "E12345678 bytes"):
        assert kinds(text) == [], text
    for text, want in [("NI number GB123456A", "GB123456A"), ("card 11010519491231002X", "11010519491231002X"), ("id 86 095 742 719 on file", "86 095 742 719"), ("passport no. C01X00T47", "C01X00T47")]:
        assert kinds(text) == [("identity", want)], text
    assert pii.tax_check("86095742719") and not pii.tax_check("86095742718") and pii.resident_check("11010519491231002X")


def test_held_out_sentences():
    from tests.llm import heldout

    for kind, (planted, found, both) in heldout.measure(pii.pieces, seed=7).items():
        assert planted >= 300 and both >= 0.9 * planted and both >= 0.95 * found, kind


def test_many_pieces_in_one_text():
    text = " ".join(f"u{k}@mail.example" for k in range(20_000))
    assert len(pii.pieces(text)) == 20_000
