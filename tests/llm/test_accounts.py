from sparkpanel.llm import pii

from .conftest import small

GB, DE, SPACED = "GB82WEST12345698765432", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
NO, MT = "NO9386011117947", "MT84MALT011000012345MTLCAST001S"


def spans(spark, texts):
    found = pii.find(small(spark, texts)).collect()
    return {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in found}


def test_valid_numbers_before_capitals_and_digits(spark):
    numbers = (GB, DE, SPACED, NO, MT)
    after = (" I said", " EUR 50", " 2024-01-05", " BIC X", " 7", " A", " 12 345 678 9012", " THE ACCOUNT OF THE FIRM", ", 5", "")
    texts = [f"é {n}{a}" for n in numbers for a in after]
    got = spans(spark, texts)
    for i, n in enumerate(n for n in numbers for _ in after):
        assert got[i] == [(2, 2 + len(n))], texts[i]


def test_numbers_beside_each_other_and_after_wrong_ones(spark):
    got = spans(spark, [f"{GB} {DE} {SPACED}", f"AT61 {SPACED}", f"NO93 {DE}", f"DE00 0000 {GB} X", f"{DE}0", f"{DE}a", f"{DE[:-1]} {GB}",
                        "DE89 3704 0044 0532 0130 01 EUR"])
    assert got[0] == [(0, 22), (23, 45), (46, 73)]
    assert got[1] == [(5, 32)] and got[2] == [(5, 27)] and got[3] == [(10, 32)]
    assert got[4] == [] and got[5] == []
    assert (22, 44) in got[6] and got[7] == []


def test_lengths_name_each_country_once():
    codes = [c for x in pii.IBAN_LENGTHS.values() for c in x.split()]
    assert len(codes) == len(set(codes)) and all(len(c) == 2 and c.isupper() for c in codes)


def valid(code, n):
    """A number of a country with n signs and remainder 1."""
    body = "".join(str((i * 7 + 3) % 10) for i in range(n - 4))
    number = "".join(str(int(c, 36)) for c in f"{body}{code}00")
    return f"{code}{98 - int(number) % 97:02d}{body}"


def test_one_valid_number_of_each_country(spark):
    numbers = [valid(c, n) for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()]
    numbers += ["SN08SN0100152000048500003035", "ML13ML0160120102600100668497", "TG53TG0090604310346500400070",
                "BF42BF0840101300463574000390", "DZ580002100001113000000570", "YE15CBYE0001018861234567891234"]
    got = spans(spark, [f"pay {n} now" for n in numbers])
    assert all(got[i] == [(4, 4 + len(n))] for i, n in enumerate(numbers))


def test_a_length_that_the_table_does_not_hold(spark):
    odd = [valid("NO", 19), valid("DE", 24), valid("ZZ", 21)]
    got = spans(spark, [f"iban {n}," for n in odd] + [f"{valid('NO', 19)[:-1]}"])
    assert [got[i] for i in range(3)] == [[(5, 5 + len(n))] for n in odd] and got[3] == []


def test_a_text_full_of_addresses_takes_near_linear_time(spark):
    import time
    text = " ".join(f"u{i}@ex.org" for i in range(50_000))
    pii.digest(pii.find(small(spark, ["warm a@b.cd"]))).collect()
    began = time.time()
    row = pii.digest(pii.find(small(spark, [text]))).first()
    assert row.n_email == 50_000 and time.time() - began < 30  # 10 s on a free machine
    last = row.spans.rsplit(",", 1)[1]
    assert last == f"email:{len(text) - len('u49999@ex.org')}:{len(text)}"
