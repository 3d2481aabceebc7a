"""Titles and issuers from the head of a text."""

from pyspark.sql import functions as F

from tessera.operators.corpus import issuer_from_text, title_of


def of(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("file", F.lit("luat_so_1.pdf"))
    return [r[0] for r in rows.select(column, "i").orderBy("i").collect()]


def test_issuers(spark):
    texts = [
        "BỘ LAO ĐỘNG - THƯƠNG BINH VÀ XÃ HỘI\nTHÔNG TƯ\nCăn cứ Luật của QUỐC HỘI",
        "ỦY BAN THƯỜNG VỤ QUỐC HỘI",
        "THÔNG TƯ\nCăn cứ Luật\nCHÍNH PHỦ",
        "Tòa án nhân dân thành phố Hà Nội\nBẢN ÁN",
        "x\nTOÀ ÁN NHÂN DÂN TỐI CAO\nQUỐC HỘI",
        "Điều 1. Phạm vi\nQUỐC HỘI",
        "Điều 12 nói\n  Quốc hội khóa X",
        "\n" * 25 + "QUỐC HỘI",
        "",
        None,
    ]
    assert of(spark, issuer_from_text(F.col("text")), texts) == ["Bộ Lao động - Thương binh và Xã hội", "Ủy ban Thường vụ Quốc hội", None, "Tòa án nhân dân thành phố Hà Nội", "TOÀ ÁN NHÂN DÂN TỐI CAO", None, "Quốc hội", None, None, None]


def test_titles(spark):
    texts = [
        "THÔNG TƯ\nQuy định điều kiện lao động\nCăn cứ Luật\n(Ban hành kèm theo Thông tư...)",
        "QUỐC HỘI\nLUẬT\nLao động\nsửa đổi\nnăm 2019\nthêm",
        "Căn cứ Hiến pháp\nLUẬT\nLao động",
        "NGHỊ ĐỊNH ban hành kèm theo\nTHÔNG TƯ\nSố: 1\nvề việc",
        "Điều 3. x\nLUẬT\ny",
        "không có gì",
        "",
        None,
    ]
    assert of(spark, title_of(F.col("text"), F.col("file")), texts) == ["THÔNG TƯ Quy định điều kiện lao động", "LUẬT Lao động sửa đổi năm 2019", "luat so 1", "THÔNG TƯ", "luat so 1", "luat so 1", "luat so 1", "luat so 1"]
