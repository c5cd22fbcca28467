"""Functions over the questions of users: normalising, routing, rewriting, memory. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Polite openings without content.
FILLER = (
    r"^(?:请问一下|请问你|请问您|请问|请帮我查一下|请帮我查查|请帮我查|请帮我看看|请帮我|请告诉我|帮我查一下|帮我查查|帮我查|帮我看看|帮我看下|帮我|"
    r"麻烦告诉我|麻烦你帮我|麻烦你|麻烦您|麻烦|我想问一下|我想问|我想知道|想请教一下|想请教|告诉我)[:：,，。\s]*"
)

#: Traditional characters and, in the same order, their simplified forms.
TRADITIONAL = "請問這個們嗎麼說話與對為會開關間見聽報銷費單資產業應該還來過學師員電腦視頻訊係統設計劃歸類檔規則製審發戶碼網絡頁數據庫體臺灣從無時處進項簽約證務財稅補貼車門長團隊專讓講讀寫認識訴試詢聯續議論討質標準備預決執現經營買賣購價錢銀額張條帳匯轉選擇記錄協詳細萬億幫週樣邊裡後髮幹幾點頭實際滿驗題況態變難"
SIMPLIFIED = "请问这个们吗么说话与对为会开关间见听报销费单资产业应该还来过学师员电脑视频讯系统设计划归类档规则制审发户码网络页数据库体台湾从无时处进项签约证务财税补贴车门长团队专让讲读写认识诉试询联续议论讨质标准备预决执现经营买卖购价钱银额张条账汇转选择记录协详细万亿帮周样边里后发干几点头实际满验题况态变难"

#: Frequent misspellings.
TYPOS = {"报消": "报销", "合通": "合同", "员功": "员工", "部们": "部门", "社宝": "社保"}

#: What tells the kinds of question apart, in order of precedence.
GREETING = r"(?i)^(?:你好|您好|嗨|哈喽|hi|hello|hey)[\s!！.。~～，,]*$"
FAREWELL = r"(?i)^(?:再见|拜拜|晚安|明天见|回头见|bye+)[\s!！.。~～，,]*$"
THANKS = r"(?i)^(?:谢谢|多谢|感谢|辛苦了|thanks|thank you)[\s!！.。~～，,]*$"
IDENTITY = r"你是谁|你叫什么|你的名字|介绍[一下]*你自己|自我介绍|你(?:都|还)?(?:会|能|可以)(?:帮我)?(?:做|干|提供)什么|你会什么|你(?:有|支持)哪些?(?:功能|能力)|怎么使用你|如何用你"
BOUNDARY = (
    r"(?i)(?:(?:你|您|助手|系统).{0,12}(?:会|能|可以|是否|是不是).{0,16}(?:回答|处理|应对|编造|胡编|虚构|检索|查找).{0,24}"
    r"(?:不存在.{0,8}知识库|知识库.{0,10}(?:没有|不存在|未收录|之外|以外|外)|(?:没有|未)(?:检索到|找到|命中)|无(?:相关)?(?:依据|资料|内容))"
    r"|(?:知识库(?:中|里|内)?(?:没有|不存在|未收录)|没有(?:检索到|找到)).{0,16}(?:你|您|助手|系统).{0,10}(?:会|能|怎么|如何|是否)"
    r"|(?:你|您|助手|系统).{0,10}(?:会不会|能否|是否可以|是否会)(?:编造|胡编|虚构).{0,12}(?:答案|内容|事实)?)"
)
DOCUMENT = r"(?:这篇|该|上述|这份)?(?:论文|文档|材料|报告|需求|代码|实现|设计)(?:中|里|内|提到|说明|规定|要求|描述|如何设计)|(?:根据|基于|按照).{0,8}(?:资料|文档|论文|材料|报告)|(?:这篇|这份|该|上述)(?:论文|文档|材料|报告)"
DATETIME = (
    r"(?i)^(?:请问|请告诉我|你知道|能告诉我|可以告诉我)?[，,]?\s*(?:(?:现在|当前|此刻|这会儿)(?:是)?(?:几点了?|几点钟?|几点几分|什么时间|什么日期|几号了?|星期几|周几|哪一天)"
    r"|(?:现在|当前|此刻|这会儿)(?:的)?(?:时间|日期)(?:是|为|是多少|是什么)?(?:多少|什么)?"
    r"|今天(?:是)?(?:几号了?|几月几[号日]|星期几|周几|什么日子|什么日期|的?日期)|(?:what\s+time\s+is\s+it|current\s+time|today'?s\s+date))(?:吗|呢|啊)?\s*[?？。!！]?$"
)
LIVE = (
    r"(?i)(?:(?:今天|明天|现在|当前|最新|实时).{0,12}(?:天气|气温|新闻|股价|股票|汇率|金价|黄金价格|油价|比分|赛况|航班|路况|空气质量|热搜))"
    r"|(?:(?:天气|股价|股票|汇率|金价|黄金价格|油价|比分|赛况|航班|路况|空气质量|热搜).{0,12}(?:怎么样|如何|多少|吗))"
)
GENERATION = r"(?i)(?:帮我|请|给我)?(?:写|创作|生成|编).{0,20}(?:诗|歌词|故事|小说|文章|作文|邮件|周报|文案|台词|剧本|笑话|代码|程序|脚本)|(?:作诗|写诗|讲(?:个|一个)?笑话|翻译成|润色一下|改写一下|重写一下)"
COUNTING = r"(?:多少|几)[一二三四五六七八九十\d]*[条篇个项种份]?[^，。？?!]{0,2}(?:参考文献|参考书目|参考资料|文献|条目)|(?:参考文献|参考书目|参考资料|文献|条目)[^，。？?!]{0,2}(?:有)?(?:多少|几)"
MODEL_TERMS = r"(?i)(?:什么|哪些|哪种).{0,10}模型|用了.{0,8}模型|模型(?:名称|型号|选型)|embedding|reranker"
MODEL_EXPANSION = " 具体模型名称 参数量 量化方式 Embedding Reranker"


def simplified(c: Column) -> Column:
    return F.translate(c, TRADITIONAL, SIMPLIFIED)


def _chinese_date(d: Column, day: bool) -> Column:
    parts = [F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月")]
    return F.concat(*parts, *([F.dayofmonth(d).cast("string"), F.lit("日")] if day else []))


def concrete_dates(c: Column, now: Column) -> Column:
    """Relative years, months, days and weekdays made concrete against the date ``now``."""
    for word, delta in (("前年", -2), ("去年", -1), ("今年", 0), ("明年", 1)):
        c = F.replace(c, F.lit(word), F.concat((F.year(now) + delta).cast("string"), F.lit("年")))
    for word, delta in (("上个月", -1), ("这个月", 0), ("下个月", 1), ("上月", -1), ("本月", 0), ("下月", 1)):
        c = F.replace(c, F.lit(word), _chinese_date(F.add_months(now, delta), False))
    for word, delta in (("前天", -2), ("昨天", -1), ("今天", 0), ("明天", 1), ("后天", 2)):
        c = F.replace(c, F.lit(word), _chinese_date(F.date_add(now, delta), True))
    monday = F.to_date(F.date_trunc("week", now))
    for prefix, week in (("上周", -1), ("本周", 0), ("这周", 0), ("下周", 1), ("星期", 0), ("周", 0)):
        for i, name in enumerate("一二三四五六日"):
            c = F.replace(c, F.lit(prefix + name), _chinese_date(F.date_add(monday, 7 * week + i), True))
    return c


def normalized(c: Column, now: Column) -> Column:
    """Simplified characters, typos, concrete dates, no polite opening, white space to one blank. Full-width ASCII becomes ASCII."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    c = simplified(F.translate(F.coalesce(c, F.lit("")), wide, "".join(chr(0x21 + i) for i in range(94)) + " "))
    for wrong, right in TYPOS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    c = F.regexp_replace(concrete_dates(c, now), FILLER, "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def variants(c: Column, most: int = 3) -> Column:
    """The question, the question without its opening, and with terms of models where it asks for models."""
    bare = strip(F.regexp_replace(strip(c), FILLER, ""))
    none = F.array().cast("array<string>")
    more = F.when(F.length(bare) >= 2, F.array(bare)).otherwise(none)
    model = F.when(c.rlike(MODEL_TERMS), F.array(F.concat(c, F.lit(MODEL_EXPANSION)))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(F.array(c), more, model)), 1, most)


def intent(c: Column) -> Column:
    """(intent, kind): chitchat with one of eight kinds, aggregate, or fact."""
    q = strip(F.coalesce(c, F.lit("")))
    free = ~q.rlike(DOCUMENT)
    kind = (
        F.when(q == "", F.lit(None)).when(q.rlike(FAREWELL), "farewell").when(q.rlike(THANKS), "thanks").when(q.rlike(GREETING), "greeting").when(q.rlike(IDENTITY), "identity")
        .when(q.rlike(BOUNDARY) & free, "capability").when(q.rlike(DATETIME) & free, "datetime").when(q.rlike(LIVE) & free, "live_info").when(q.rlike(GENERATION) & free, "general_generation")
    )
    return F.struct(F.when(kind.isNotNull(), "chitchat").when(q.rlike(COUNTING), "aggregate").otherwise("fact").alias("intent"), kind.alias("kind"))


#: Words that point back to what was said.
DEICTIC = r"它|他|她|他们|它们|这个|那个|这些|那些|刚才|上面|上述|之前|继续|还有呢|为什么"
FOLLOW_UP = r"^(?:那|那么|然后|还有|接着|其次|再|另外|嗯|哦|所以)"
REMEMBER = r"记住[：:，,]?\s*(.{2,200})"
PROFILE = r"(?:我|我们|公司|团队)的\s*([^\s，,。；;：:]{1,12})\s*(?:是|为)\s*([^\s，,。；;]{1,100})"


def rewritten(query: Column, last_user: Column) -> Column:
    """The question with the one before it in front where it points back, follows up, or has six characters at most."""
    q = strip(F.coalesce(query, F.lit("")))
    needs = q.rlike(DEICTIC) | q.rlike(FOLLOW_UP) | (F.length(q) <= 6)
    return F.when((q == "") | last_user.isNull() | (last_user == "") | (last_user == q) | ~needs, q).otherwise(F.concat(F.substring(last_user, 1, 80), F.lit("；"), q))


def remembered(c: Column) -> Column:
    """What a message asks to remember: an array of (key, value)."""
    t = strip(F.coalesce(c, F.lit("")))
    kind = "array<struct<key:string,value:string>>"
    told = F.transform(F.regexp_extract_all(t, F.lit(REMEMBER), F.lit(1)), lambda v: F.struct(F.lit("用户叮嘱").alias("key"), F.regexp_replace(strip(v), "[。.！!？?]+$", "").alias("value")))
    keys, values = (F.regexp_extract_all(t, F.lit(PROFILE), F.lit(i)) for i in (1, 2))
    facts = F.zip_with(keys, values, lambda k, v: F.struct(strip(k).alias("key"), strip(v).alias("value")))
    return F.filter(F.concat(told.cast(kind), facts.cast(kind)), lambda x: (x["key"] != "") & (x["value"] != ""))
