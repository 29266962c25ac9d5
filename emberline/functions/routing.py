"""Question routing by keywords, and parsing of labels and plans that a model returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.jsontext import unfenced
from emberline.functions.text import strip

# Question types, agents, their labels, and the keyword patterns.
QUESTION_TYPES = ("optimization", "factual", "comparison", "causal", "process", "recommendation", "general_chat")
COMPLEX_TYPES = ("comparison", "causal", "recommendation")
NO_RETRIEVAL_TYPES = ("general_chat", "optimization")
AGENTS = ("coal_price", "oven_control", "optimization", "data_management", "knowledge_qa", "simple_chat")
AGENT_LABELS = {
    "optimization": "配煤优化",
    "knowledge_qa": "知识问答",
    "simple_chat": "闲聊",
    "coal_price": "煤价查询",
    "data_management": "数据管理",
    "oven_control": "焦炉操作",
}
AGENT_TYPES = {"optimization": "optimization", "knowledge_qa": "factual", "simple_chat": "general_chat"}
DEFAULT_AGENT, DEFAULT_TYPE = "knowledge_qa", "factual"
OPTIMIZATION_KEYWORDS = (
    r"(?i)配煤|配比|优化配|煤种|煤样"
    r"|预测.*(?:CRI|CSR|质量)|(?:CRI|CSR|M10|M25).*(?:大于|小于|范围|要求|限制|预测)"
    r"|成本最低|最优方案|混合比例|配方|料斗|blend|opti"
    r"|哪些煤|可用.*煤|查.*煤|列.*煤|煤.*列表|煤.*查"
    r"|多模型|模型.*对比|对比.*预测"
    r"|优化.*方案|方案.*优化"
)
PRICE_KEYWORDS = r"成交价|煤价|报价|行情|市场价|今日.*价|价格查询|煤炭.*价格|焦煤.*价格"
OVEN_KEYWORDS = r"填入.*焦炉|装入.*焦炉|焦炉.*装|焦炉.*填|开启.*孪生|数字孪生.*监控|启动.*监控|开启.*监控|关闭.*监控"
DATA_KEYWORDS = (
    r"添加.*煤|新增.*煤|录入.*煤|删除.*煤|移除.*煤|修改.*煤|更新.*煤"
    r"|加一个煤|加几个煤|加条煤|查看.*煤样|所有煤样|煤样.*列表|煤样.*数据库"
    r"|CNN.*预测|用CNN|用模型预测"
)
GREETING = r"(?i)^(你好|hi|hello|嗨|早|在吗|你是谁)\s*[?？!！。.]*$"


def _says(question: Column, pattern: str) -> Column:
    """Any line end but a line feed is a character, and white space and letter case are those of Unicode."""
    return question.rlike("(?udU)" + pattern)


def keyword_agent(question: Column) -> Column:
    """The agent a keyword decides, or null when a model would have to."""
    return (
        F.when(_says(question, PRICE_KEYWORDS), "coal_price")
        .when(_says(question, OVEN_KEYWORDS), "oven_control")
        .when(_says(question, DATA_KEYWORDS), "data_management")
        .when(_says(question, GREETING), "simple_chat")
    )


def is_optimization(question: Column) -> Column:
    return _says(question, OPTIMIZATION_KEYWORDS)


def normal_label(label: Column) -> Column:
    """A model's answer as a question type: exact, then contained in declared order, else factual."""
    clean = F.translate(F.lower(strip(label)), "\"'", "")
    chain = F.when(clean.isin(*QUESTION_TYPES), clean)
    for name in QUESTION_TYPES:
        chain = chain.when(F.contains(clean, F.lit(name)), name)
    return chain.otherwise(DEFAULT_TYPE)


def question_type(question: Column, label: Column) -> Column:
    return F.when(is_optimization(question), "optimization").otherwise(normal_label(label))


def is_complex(kind: Column) -> Column:
    return kind.isin(*COMPLEX_TYPES)


def needs_retrieval(kind: Column) -> Column:
    return ~kind.isin(*NO_RETRIEVAL_TYPES)


def agent_plan(reply: Column) -> Column:
    """Known agents of a plan reply, in order; the default agent when none is left or it is broken."""
    parsed = F.from_json(unfenced(reply), "agents array<string>, reasoning string")
    known = F.filter(parsed["agents"], lambda a: a.isin(*AGENTS))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(DEFAULT_AGENT)))


def plan_for(question: Column, reply: Column) -> Column:
    """Keywords first, then the parsed reply."""
    quick = keyword_agent(question)
    return F.when(quick.isNotNull(), F.array(quick)).otherwise(agent_plan(reply))


def _lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), default)


def agent_type(agent: Column) -> Column:
    return _lookup(AGENT_TYPES, agent, F.lit(DEFAULT_TYPE))


def agent_label(agent: Column) -> Column:
    return _lookup(AGENT_LABELS, agent, agent)


def plan_display(plan: Column) -> Column:
    return F.array_join(F.transform(plan, agent_label), " → ")


def route_after_plan(plan: Column, at: Column) -> Column:
    """The next step for position ``at`` of a plan; past the end it is small talk."""
    agent = F.get(plan, at)
    return (
        F.when(at >= F.size(plan), "simple_chat")
        .when(agent == "optimization", "edu_optimization")
        .when(agent == "simple_chat", "simple_chat")
        .otherwise("translate")
    )


def route_after_graph(kind: Column, chunk_count: Column) -> Column:
    return F.when(is_complex(kind) & (chunk_count > 0), "reason").otherwise("generate")
