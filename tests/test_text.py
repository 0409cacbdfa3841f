import re
import unicodedata

from pyspark.sql import functions as F

from folio import constants as K
from folio.functions import prompts, text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strip_removes_what_python_removes(spark):
    blanks = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    assert set(blanks) == set(X.WHITESPACE)
    text = "".join(blanks) + "a b" + "".join(reversed(blanks))
    assert one(spark, X.strip(F.lit(text))) == text.strip() == "a b"


def test_form_field_keeps_control_separators(spark):
    assert one(spark, X.strip_form_field(F.lit("﻿ 　q\x1c "))) == "q\x1c"


def test_fields_keep_odd_spaces_and_empties(spark):
    for line in ["a  b", "a   b", "a    b", "a  b  ", ""]:
        assert one(spark, X.fields_of(F.lit(line))) == line.split("  ")


def test_items_split_on_wide_spaces(spark):
    for line in ["a  b", "a　　b c", "  a \t b  ", "　", "a\x1c\x1cb"]:
        want = [p.strip() for p in re.split(r"\s{2,}", line) if p.strip()]
        assert one(spark, X.items_of(F.lit(line))) == want


def test_numbered_lines(spark):
    for line in ["1.x", "12.", "１２.x", "1x", "a1.", "٣.x"]:
        assert one(spark, X.is_numbered(F.lit(line))) == bool(re.match(r"^\d+\.", line))


def test_pieces_between_markers(spark):
    s = "xAyBzAwB"
    assert one(spark, X.between(F.lit(s), "A", "B")) == s.split("A")[1].split("B")[0]
    assert one(spark, X.piece_after(F.lit("a:b:c"), ":")) == "b"
    assert one(spark, X.piece_after(F.lit("abc"), ":")) is None
    assert one(spark, X.tail_after(F.lit("a:b:c"), ":")) == "b:c"
    assert one(spark, X.head_before(F.lit("abc"), ":")) == "abc"


def test_numbered_items_cut_every_digit_run(spark):
    s = X.remove(F.lit("1.甲 乙\n2. 丙3两"), "\n", " ")
    assert one(spark, X.numbered_items(s)) == ["甲乙", "丙", "两"]


def test_file_stem_ends_at_first_dot(spark):
    for path, stem in [("/a/b.x.pdf", "b"), ("c.pdf", "c"), ("/a.b/c", "c")]:
        assert one(spark, X.file_stem(F.lit(path))) == stem


def test_lines_know_all_line_ends(spark):
    assert one(spark, X.lines_of(F.lit("a\r\n b\rc\n\nd"))) == ["a", "b", "c", "", "d"]


def test_special_tokens_go(spark):
    assert one(spark, X.drop_special_tokens(F.lit("<|im_start|>a<|im_end|>b<|endoftext|>"))) == "ab"


def test_markup(spark):
    html = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><!-- x --><p>A &amp; B<br>C</p><p>D</body>"
    assert one(spark, X.markup_to_text(F.lit(html))) == "A & B\nC\nD"


def test_training_chat_bytes(spark):
    want = (
        "<|im_start|>system\n你是一个中医助手，帮助用户匹配方剂名称。\n<|im_end|>\n"
        "<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\nA<|im_end|>"
    )
    assert one(spark, prompts.training_chat(F.lit("Q"), F.lit("A"))) == want


def test_answer_prompt_bytes(spark):
    assert one(spark, prompts.answer_prompt(F.lit("q"), F.lit(""))) == "Question: q\n 请给我中文回答。Answer:"
    line = prompts.context_line(*[F.lit(x) for x in "tabdf"])
    assert one(spark, line) == "'t  a  b  d  f' \n"
    assert (
        one(spark, prompts.answer_prompt(F.lit("q"), line))
        == "Context: 't  a  b  d  f' \n\nQuestion: q\n 请给我中文回答。Answer:"
    )


def test_other_prompts(spark):
    assert one(spark, prompts.name_question(F.lit("x"))) == "方剂组成：x\n请给出该方剂的名称。"
    assert one(spark, prompts.sse_frame(F.lit("x"))) == "data: x\n\n"
    assert one(spark, prompts.full_model_name(F.lit("m"))) == "Qwen/m"
    assert one(spark, prompts.full_model_name(F.lit("o/m"))) == "o/m"
    assert one(spark, prompts.paraphrase_prompt(F.lit("x"))).endswith("：\nx")


def test_templates_have_one_place_each():
    assert all(t.count("{}") == 1 for t in K.INPUT_TEMPLATES + K.OUTPUT_TEMPLATES)
    assert len(K.INPUT_TEMPLATES) == 5 and len(K.OUTPUT_TEMPLATES) == 6 and len(K.SECTION_TITLES) == 9
    assert unicodedata.normalize("NFC", K.SYSTEM_TURN) == K.SYSTEM_TURN
