"""Values that define the review data model."""

# Stored labels and texts, so they stay as they are.
STATUSES_TASK = ("激活", "解决", "关闭")
RECORD_STANDARD, RECORD_COMPARE = "标准校对", "原稿比对"
LEGACY_TASK = "历史归档"
LAYERS = ("错误类", "存疑类", "引文类", "风格类")
CONFIRMED, DOUBTFUL, QUOTATION, OPTIONAL = LAYERS
PRIORITIES = ("高", "中", "低", "可选")
HIGH, MEDIUM, LOW, LEISURE = PRIORITIES
DEEP, SIMPLIFIED = "深度", "精简"
PENDING, ACCEPTED, REJECTED = "待处理", "已采纳", "已拒绝"
CATEGORIES = ("normal", "quotation", "factual", "style")
CONFIDENCES = ("high", "medium", "low")
CONFIDENCE_LABELS = {"high": "高", "medium": "中", "low": "低"}
DIFF_KINDS = {"insert": "新增内容", "delete": "删除内容", "replace": "文字替换"}
TYPE_TYPO, TYPE_PUNCTUATION, TYPE_GRAMMAR = "错别字与拼写", "标点符号问题", "语法结构问题"
TYPE_QUOTATION, TYPE_FACT = "引用与成语准确性", "常识与事实性错误"
HIGH_PRIORITY_TYPES = ("政治敏感性表述", "民族与地名规范")
UNLOCATED = "未定位"
OLD_LAYERS = {"确定性错误": "错误类", "存疑待核实": "存疑类", "风格可选": "风格类"}

# Sizes and thresholds.
CHUNK_TARGET, CHUNK_MAX, OVERLAP = 3000, 4500, 2
OVERLAP_MARK = "【上文回顾，仅供理解上下文，此部分的问题不要报告】"
BODY_MARK = "【正文开始，请校对以下内容】"
UNREADABLE = "□"
OCR_DOWNGRADE, OCR_DROP_CONFIDENCE, OCR_DROP_CHARS = 0.90, 0.6, 4
QUOTE_CHARS, PARTICLES, PARTICLE_DENSITY, PARTICLE_COUNT = 10, "之乎者也矣焉哉", 0.06, 2
CUTOFF_YEAR, GRACE_YEARS = 2026, 2
REJECTION_THRESHOLD, HISTORY_TURNS, CONTEXT_BLOCKS, KEEP_FILES, MAX_CALLS = 3, 5, 2, 10, 8
ZONE_RATIO = 0.08

# Keyword lists.
TITLE_WORDS = ("部长", "主任", "总裁", "董事长", "教授", "院士", "书记", "市长", "省长", "主席", "总经理", "校长", "局长", "厅长", "秘书长", "会长", "理事长")
ORG_WORDS = ("公司", "集团", "协会", "委员会", "大学", "医院", "研究院", "研究所")
STYLE_WORDS = ("更通顺", "更简洁", "建议润色")
DASH_WORDS = ("破折号", "连接号", "短横线", "分隔号", "间隔号")
RECENCY_WORDS = ("训练数据", "知识截止", "知识范围", "我的认知", "未收录", "无法查证是否存在", "较新", "尚未听说", "无法确认该时间点", "超出我的知识")
LAYOUT_WORDS = ("排版错乱", "跨行", "错行", "错位", "乱码", "段落顺序", "图片位置")
NON_ISSUE_WORDS = ("不应报告为问题", "不报告为问题", "不作为问题报告", "不应作为问题", "不视为问题", "不属于问题", "历史反馈规避")
EXEMPT_TYPES = ("常识与事实性错误",)
SIMPLIFIED_RULES = (1, 2, 9, 10)

# Punctuation sets.
SENTENCE_END = "。！？；"
CLAUSE_END = "。！？；，、：\n"
TERMINAL = "。！？"
LINE_STOPS = "。！？；…：.!?;:）)》」』】〕》\"'”’"

# Traditional forms, and radicals without a compatibility form, to the characters they stand for.
TRADITIONAL = {"戶": "户", "門": "门", "馬": "马", "車": "车", "頁": "页", "見": "见", "貝": "贝", "風": "风", "長": "长", "齒": "齿", "龜": "龟", "黽": "黾", "麥": "麦", "黃": "黄", "韋": "韦", "飛": "飞", "魚": "鱼", "鳥": "鸟", "龍": "龙", "齊": "齐", "鹵": "卤", "語": "语", "貞": "贞", "隸": "隶"}
RADICALS = {"⻔": "门", "⻋": "车", "⻓": "长", "⻛": "风", "⻆": "角", "⻰": "龙", "⻚": "页", "⻩": "黄", "⻜": "飞", "⻢": "马", "⻅": "见", "⻨": "麦", "⻣": "骨", "⻙": "韦"}

# Layout labels.
LABEL_TYPES = {
    "heading": ("doc_title", "paragraph_title", "abstract_title", "reference_title", "content_title"),
    "paragraph": ("text", "content", "abstract", "reference", "formula", "algorithm", "aside_text"),
    "footnote": ("footnote",),
    "table": ("table",),
    "figure_caption": ("table_title", "chart_title", "figure_title", "figure_table_chart_title"),
}
DROPPED_LABELS = ("image", "figure", "chart", "flowchart", "seal", "header", "header_image", "footer", "footer_image", "number")
