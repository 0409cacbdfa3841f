"""Fixed values that results depend on. Each must stay exactly as it is."""

# The nine section titles of the medicine-pair book, in book order.
SECTION_TITLES = [
    "相须药对",
    "相反药对-扶正祛邪相反药对",
    "相反药对-寒热相反药对",
    "相反药对-升降相反药对",
    "相反药对-润燥相反药对",
    "相反药对-散敛相反药对",
    "相反药对-其它相反药对",
    "相使药对",
    "十八反、十九畏药对",
]

# Markers of the question/answer text.
INGREDIENTS_MARK = "方剂组成："
METHODS_MARK = "制备方法："
NAME_MARK = "方剂名称："

# Words that decide the role of a line inside a formula.
FORMULA_WORD = "方"
DOSE_WORD = "右"
WATER_WORD = "以水"

# Question wordings; {} is the ingredient text.
INPUT_TEMPLATES = [
    "请根据以下药材组成预测方剂名称：{}",
    "这个方剂由 {} 组成，请推测其名称。",
    "以下药方包含：{}，请问它叫什么？",
    "该方剂主要成分为：{}，你能猜出它的名字吗？",
    "请告诉我，{} 对应的方剂名称是什么？",
]

# Answer wordings; {} is the formula name. The last one is the name itself.
OUTPUT_TEMPLATES = [
    "该方剂名称是：{}",
    "这个方剂被称为 {}",
    "它的名字是 {}",
    "{} 是这个方剂的名称",
    "正确答案是 {}",
    "{}",
]

# Prompts.
SYSTEM_TURN = "你是一个中医助手，帮助用户匹配方剂名称。"
PARAPHRASE_PROMPT = (
    "请根据以下方剂组成，生成 10 个不同表述方式的输入, 每个输入都要包含所有药物，"
    "请注意两、斤、升等属于度量单位，不属于药物，同时，小括号内一般为制备方式，"
    "请不要修改，请现在开始生成：\n"
)
NAME_QUESTION_SUFFIX = "\n请给出该方剂的名称。"
ANSWER_REQUEST = "\n 请给我中文回答。Answer:"
ANSWER_MARK = "Answer:"

# Sizes.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
RETRIEVAL_K = 10
TEMPLATE_COPIES = 5
SPLIT_SEED = 42
HOLDOUT_PERCENT = 20
IGNORED_LABEL = -100
BATCH_ROWS = 8
PAD_MULTIPLE = 8
