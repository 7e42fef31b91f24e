"""Literal texts and exactly what has to be found in them."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions.rulebook import NOT_A_NAME, rules_for
from maskloom.operators.detect import detect

CASES = [
    ("EMAIL", "Contact me at john@example.com please", ["john@example.com"]),
    ("EMAIL", "john@work.com and jane@home.org", ["john@work.com", "jane@home.org"]),
    ("EMAIL", "Meet me at 3pm", []),
    ("EMAIL", "我的電郵是testuser@example.com", ["testuser@example.com"]),
    ("EMAIL", "testuser@example.com已收到", ["testuser@example.com"]),
    ("PHONE_NUMBER", "Call me at +852 98765432", ["+852 98765432"]),
    ("PHONE_NUMBER", "My number is 61234567", ["61234567"]),
    ("PHONE_NUMBER", "Fax: 6123-4567", ["6123-4567"]),
    ("PHONE_NUMBER", "+853 61234567", ["+853 61234567"]),
    ("PHONE_NUMBER", "Order #12345", []),
    ("PHONE_NUMBER", "電話61234567", ["61234567"]),
    ("PHONE_NUMBER", "辦公電話28512345", ["28512345"]),
    ("PHONE_NUMBER", "國內手機13800138000", ["13800138000"]),
    ("PHONE_NUMBER", "Call +86 13800138000", ["+86 13800138000"]),
    ("PHONE_NUMBER", "20260701-00125", []),
    ("PHONE_NUMBER", "錯誤code：96510246", []),
    ("PHONE_NUMBER", "參考編號74111111", []),
    ("PHONE_NUMBER", "x61234567 61234567", ["61234567"]),
    ("PHONE_NUMBER", "電話6１２３４５６７", ["6１２３４５６７"]),
    ("IP_ADDRESS", "Server is at 192.168.1.1", ["192.168.1.1"]),
    ("IP_ADDRESS", "From 10.0.0.1 to 172.16.0.1", ["10.0.0.1", "172.16.0.1"]),
    ("IP_ADDRESS", "Version 1.2.3 is out", []),
    ("IP_ADDRESS", "伺服器192.168.1.1", ["192.168.1.1"]),
    ("HKID", "My HKID is A123456(7)", ["A123456(7)"]),
    ("HKID", "ID: AB123456(8)", ["AB123456(8)"]),
    ("HKID", "See section A1(2)", []),
    ("HKID", "身份證A123456(7)", ["A123456(7)"]),
    ("HKID", "a123456(7) and b654321(a)", ["a123456(7)", "b654321(a)"]),
    ("HKID", "1234A123456(7)", []),
    ("MACAU_ID", "Macau ID: 1234567(8)", ["1234567(8)"]),
    ("MACAU_ID", "ID NO.: 11234567", ["11234567"]),
    ("MACAU_ID", "身份證14567890", ["14567890"]),
    ("MACAU_ID", "5123456(7)", ["5123456(7)"]),
    ("MACAU_ID", "7123456(8)", ["7123456(8)"]),
    ("MACAU_ID", "ID: 28512345", []),
    ("MACAU_ID", "8123456(9)", []),
    ("PASSPORT", "Passport H12345678", ["H12345678"]),
    ("PASSPORT", "護照K12345678", ["K12345678"]),
    ("PASSPORT", "h12345678", ["h12345678"]),
    ("LICENSE_PLATE", "Car plate AB 1234", ["AB 1234"]),
    ("LICENSE_PLATE", "車牌MX-00-00", ["MX-00-00"]),
    ("LICENSE_PLATE", "Born on 1990-01-15", []),
    ("LICENSE_PLATE", "He went to 2345 block", []),
    ("LICENSE_PLATE", "Please go to 5678 room", []),
    ("CREDIT_CARD", "Card: 4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("CREDIT_CARD", "4111111111111111", ["4111111111111111"]),
    ("CREDIT_CARD", "1234567890123456", []),
    ("CREDIT_CARD", "信用卡4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("CREDIT_CARD", "銀聯卡6200000000000005", ["6200000000000005"]),
    ("CREDIT_CARD", "378282246310005", ["378282246310005"]),
    ("CREDIT_CARD", "5500000000000004", ["5500000000000004"]),
    ("CREDIT_CARD", "3566002020360505", ["3566002020360505"]),
    ("CREDIT_CARD", "5500-0000-0000-0004", []),
    ("CREDIT_CARD", "4111111111111111 。", ["4111111111111111 "]),
    ("CREDIT_CARD", "4111111111111111 end", ["4111111111111111"]),
    ("ADDRESS", "地址是中環德輔道中1號", ["地址是中環德輔道"]),
    ("ADDRESS", "Office at 1 Des Voeux Rd, Central", ["1 Des Voeux Rd"]),
    ("ADDRESS", "住在太古城中心", ["住在太古城中心"]),
    ("ADDRESS", "The road is long", []),
    ("ADDRESS", "此系統是一個線上服務平臺，提供市民查詢功能", []),
    ("ADDRESS", "富裕臺8號", ["富裕臺8號"]),
    ("ADDRESS", "Rua de Exemplo", ["Rua de Exemplo"]),
    ("ADDRESS", "Avenida de Teste Grande", ["Avenida de Teste Grande"]),
    ("ADDRESS", "Av. do Exemplo", ["Av. do Exemplo"]),
    ("ADDRESS", "Edifício Comercial Teste", ["Edifício Comercial Teste"]),
    ("ADDRESS", "住在Rua de Exemplo", ["Rua de Exemplo"]),
    ("ADDRESS", "This project is almost done", []),
    ("ADDRESS", "The rd is bumpy", []),
    ("ADDRESS", "Walk down the ave", []),
    ("ADDRESS", "123 MAIN ST", ["123 MAIN ST"]),
    ("ADDRESS", "EDIFÍCIO COMERCIAL TESTE", ["EDIFÍCIO COMERCIAL TESTE"]),
    ("ADDRESS", "A rua é longa", []),
    ("ADDRESS", "Jean Stéphane", ["Jean St"]),
    ("PERSON", "本人姓名：施例男", ["施例男"]),
    ("PERSON", "本人的子女：施例男", ["施例男"]),
    ("PERSON", "申請人簽署：陳大文", ["陳大文"]),
    ("PERSON", "性別：男", []),
    ("PERSON", "姓名：ALVES TESTE RODRIGUES", ["ALVES TESTE RODRIGUES"]),
    ("PERSON", "姓名：João da Silva Teste", ["João da Silva Teste"]),
    ("PERSON", "申請人：Pedro dos Santos Exemplo", ["Pedro dos Santos Exemplo"]),
    ("PERSON", "ID：12345678", []),
    ("BANK_ACCOUNT", "Account number 123456789012", ["123456789012"]),
    ("BIRTHDAY", "Born on 1990-01-15", ["1990-01-15"]),
    ("BIRTHDAY", "DOB: 15/01/1990", ["15/01/1990"]),
    ("BIRTHDAY", "生日1990-01-15", ["1990-01-15"]),
    ("EMAIL", "", []),
    ("EMAIL", "   ", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, e, t) for i, (e, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, entity string, text string")
    out = {}
    for entity in sorted({c[0] for c in CASES}):
        part = df.filter(F.col("entity") == entity)
        for row in detect(part, entities=[entity]).collect():
            for s in row.spans:
                assert row.text[s.start:s.end] == s.value
            out[row.id] = [s.value for s in row.spans]
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{i}")
def test_literal(found, i):
    assert found[i] == CASES[i][2]


def test_rule_pruning():
    assert {r.entity_type for r in rules_for(["EMAIL"])} == {"EMAIL"}
    assert "BIRTHDAY" not in {r.entity_type for r in rules_for()}
    assert "BIRTHDAY" in {r.entity_type for r in rules_for(profile="extended")}
    with pytest.raises(ValueError):
        rules_for(["NOPE"])
    assert len(NOT_A_NAME) == 116


def test_whole_profile(spark):
    """All rules at once on one mixed text, with private-use characters in it."""
    text = "\ue000A\ue001 電話 66111111, john@test.com +852 98765432 A123456(7) 姓名：陳大文"
    row = detect(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.entity_type, s.value) for s in row.spans] == [
        ("PHONE_NUMBER", "66111111"), ("EMAIL", "john@test.com"), ("PHONE_NUMBER", "+852 98765432"),
        ("HKID", "A123456(7)"), ("PERSON", "陳大文"),
    ]
    assert all(text[s.start:s.end] == s.value for s in row.spans)


def test_very_long_runs_do_not_recurse(spark):
    """Thousands of words in one street run, and thousands of numbers in one text."""
    street = "Rua " + "palavra " * 20000
    avenue = "Big " * 20000 + "Rd"
    numbers = ", ".join(f"6{i:07d}" for i in range(3000))
    rows = [(0, street), (1, avenue), (2, numbers)]
    got = {r.id: r.spans for r in detect(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [(s.start, s.end) for s in got[0]] == [(0, len(street.rstrip()))]
    assert [(s.start, s.end) for s in got[1]] == [(0, len(avenue))]
    assert len(got[2]) == 3000
    assert all(numbers[s.start:s.end] == s.value for s in got[2])
