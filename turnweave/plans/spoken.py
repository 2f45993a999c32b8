"""Relations over whole tables that stand for what operators get: SQL text that Spark and the comparison both read.

Sayings are put together from fragments by the id of an event, so that every row of ``events`` is one and all
combinations occur; verdicts, scores and places come from ids in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "conversations", "documents", "labels")


def values(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """The rows of a relation text, over the tables of a folder."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in relation}
    for t in named:
        relation = relation.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(f"SELECT * FROM {relation}", **named)


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return f"{x!r}e0" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def step(n: int = 1, key: str = "event_id") -> str:
    """The key by steps of n."""
    return f"CAST(floor({key} / {n}e0) AS BIGINT)"


def pick(items, n: int = 1, key: str = "event_id") -> str:
    """One of the items, the next one every n ids."""
    cases = " ".join(f"WHEN {i} THEN {literal(x)}" for i, x in enumerate(items))
    return f"CASE {step(n, key)} % {len(items)} {cases} END"


def flag(k: int, n: int = 1, key: str = "event_id") -> str:
    """True for one in k."""
    return f"{step(n, key)} % {k} = 0"


DIALOGUE = "CAST(user_id AS STRING) AS dialogue_id"
TEXTS = f"(SELECT event_id AS id, {pick(['我会 ', '就可以  ', 'A b ', '', '能够将来的', '的了', '就会将会'])} || {pick(['确认的', '取消了', 'C', '', '事', '可以就能', ' 生效 了'], 7)} AS s FROM events) AS t"
PAIRS = (
    f"(SELECT event_id AS id, {pick(['次日生效', '10单', '确认您是负责人', '平台规则说明', '', 'ABC', '取消报名操作入口', '三点', '可以', '不用付钱的', '价格和时间', '连续履约，奖励'])} AS a, "
    f"{pick(['取消后次日就会', '10天以后', '请问您是不是', '规则平台的', 'x', 'xx a b c', '您在入口操作报名之后', '三天点', '不可以', '不 用付钱', '价格以及时间', '连续10天履约'], 12)} || "
    f"{pick(['生效的', '', '负责人呢我确认', '说明如下', '再取消', '奖励', ' 10 单', 'abc'], 144)} AS b FROM events) AS t"
)
ORDERED = (
    f"(SELECT event_id AS id, {pick(['取消操作次日生效', '短语', '不能保证一定收到', '甲乙丙丁戊己', '报名12次以上', '进入页面确认提交'])} AS a, "
    f"{pick(['取消的', '生效次日', '甲12345678901234567890', '不能保证', '进入', ''], 6)} || {pick(['操作在次日才', '操作取消', '乙丙丁戊己', '一定收到', '那个页面再确认', '短语'], 36)} || {pick(['生效', '以后提交', '', '之后'], 216)} AS b FROM events) AS t"
)
NUMBERED = (
    f"(SELECT event_id AS id, {pick(['满', '共', '', '下午', '晚上', '约 '])} || {pick(['', '十二', '两'], 5)} || CAST(event_id % 41 AS STRING) || {pick(['单', '元', '-', '到', '.5小时', '', ':00', '~'], 3)} || "
    f"CAST(event_id % 19 AS STRING) || {pick(['点', '天', '分钟', '单', '元', '', '%'], 2)} || {pick(['', '今天', '次日生效', '立刻', '前一天', '隔天', '当场', '上一天'], 11)} AS s FROM events) AS t"
)
FACTS = (
    f"(SELECT event_id AS id, {pick(['次日生效', '10单', '10元', '次日', '好', '次日10元', '5到10秒', '18点', '十二天', '前一天18点前'])} AS expected, "
    f"{pick(['今天', '第二天', '', '明天', '前日', '不能按'], 10)} || {pick(['10', '12', '', '十', '5-10', '下午6', '二十'], 60)} || {pick(['元', '单', '秒', '点', '天', '生效', ''], 420)} AS actual FROM events) AS t"
)
TAGGED = (
    f"(SELECT event_id AS id, {pick(['您好，请问', '好的', '开车呢', 'thank', '我给你安排', '以系统为准', '通知一下', '不能保证'])} || {pick(['您是负责人吗', '再见', '', ' you', '结果成功', '规则说明', '没时间，稍后再说', '保证收到', '继续简单说'], 8)} AS s, "
    f"{pick(['assistant', 'user', 'unknown'], 5)} AS who FROM events) AS t"
)
LISTED = f"(SELECT event_id AS id, array({pick(['A b', 'ab', ' ', 'c', ''])}, {pick(['ab', 'x', 'C'], 5)}, {pick([' ', 'X ', 'A  B', 'd'], 15)}, {pick(['c', 'C', 'x'], 2)}) AS items FROM events) AS t"
FAMILY = ["knowledge", "flow", "constraint"]
ERRORS = (
    f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS error_id, {pick(FAMILY)} AS family, {pick(['k1', '', 'k9', 'n3', 'c1'], 3)} AS target_id, {pick(['次日生效', '取消入口', '十元奖励', '', '保证收到'], 2)} AS span, "
    f"{flag(3)} AS eligible FROM events WHERE event_id % 7 < 2) AS t"
)
EVENTS = (
    f"(SELECT {DIALOGUE}, {pick(FAMILY, 2)} AS family, {pick(['k7', 'n3', 'k2', 'c1'])} AS event_target, {pick(['k1', '', 'k9'], 5)} AS alias, {pick(['我们是今天生效', '次日生效的', '完全无关', '取消的入口在这里', ''], 3)} AS evidence, "
    "event_id FROM events WHERE event_id % 7 > 4) AS t"
)
MEASURES = (
    f"(SELECT CAST(event_id AS STRING) AS group_id, {pick(['node_positive', 'knowledge_positive', 'node_trigger', 'default', 'constraint_negative'])} AS rule_type, {pick(['same_atom', 'same_turn_adjacent_2', 'same_turn_adjacent_3'], 2)} AS window_name, "
    f"{pick([1.0, 0.92, 0.82], 2)} AS factor, {pick([0.0, 0.25, 0.5, 0.9, 1.0], 3)} AS raw_group, {pick([0.0, 0.3, 0.6, 1.0], 7)} AS raw_core, 2 + event_id % 3 AS n_core, event_id % 3 AS n_core_hit, event_id % 4 AS n_plain_hit, "
    f"{step(5)} % 2 AS n_fact, CASE WHEN {flag(4, 5)} THEN 1 ELSE 0 END AS n_fact_missing, CASE WHEN {flag(6, 3)} THEN 1 ELSE 0 END AS n_trunk_missing, CASE WHEN {flag(5, 11)} THEN 1 ELSE 0 END AS n_precise_missing, "
    f"CASE WHEN {flag(3, 13)} THEN 1 ELSE 0 END AS n_cluster_missing, {flag(4, 17)} AS require_all FROM events) AS t"
)
VERDICTS = ["hit", "review", "miss"]
GROUPS = (
    f"(SELECT {pick(['r', 's'])} AS rule_id, {DIALOGUE}, CAST({step(2)} % 3 AS INT) AS a_turn, CAST({step(5)} % 2 AS INT) AS a_seq, CAST({step(3)} % 3 AS INT) AS window_ord, {step(7)} % 3 > 0 AS decisive, "
    f"{pick(VERDICTS, 11)} AS verdict, (event_id % 128) / 128e0 AS score FROM events) AS t"
)
REQUIREMENTS = (
    f"(SELECT {DIALOGUE}, {pick(['n1', 'n2', 'n3'])} AS node_id, 1e0 + event_id % 3 AS weight, {step(3)} % 4 > 0 AS required, CASE WHEN {flag(5, 2)} THEN 0e0 ELSE (event_id % 128) / 128e0 END AS score, {flag(2, 3)} AS matched, "
    f"CASE WHEN {flag(2, 3)} THEN CAST(event_id % 9 AS INT) END AS turn_index FROM events) AS t"
)
#: A node of a dialogue is a group of events; its numbers come from their first id.
_NODE = "FROM events GROUP BY user_id, event_id % 6"
_FIRST = "min(event_id)"
RESULTS = (
    f"(SELECT {DIALOGUE}, CASE event_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'e' WHEN 4 THEN 'f' ELSE 't' END AS node_id, {_FIRST} % 5 > 0 AS active, ({_FIRST} % 101) / 128e0 AS score, "
    f"{pick(['已完成', '缺失', '部分完成', '未激活'], 1, _FIRST)} AS status, CASE WHEN {_FIRST} % 3 > 0 THEN CAST({_FIRST} % 11 AS INT) END AS first_hit_turn {_NODE}) AS t"
)
MEMBERS = (
    f"(SELECT {DIALOGUE}, CASE event_id % 6 WHEN 0 THEN 'g1' WHEN 1 THEN 'g1' WHEN 2 THEN 'g1' WHEN 3 THEN 'g2' ELSE 'g3' END AS group_id, CASE event_id % 6 WHEN 0 THEN 'sequential' WHEN 1 THEN 'sequential' WHEN 2 THEN 'sequential' WHEN 3 THEN 'all_of' ELSE 'exclusive_branch' END AS group_type, "
    f"CAST(event_id % 6 AS INT) AS position, {_FIRST} % 7 > 1 AS active, ({_FIRST} % 101) / 128e0 AS score, {pick(['已完成', '缺失', '部分完成'], 1, _FIRST)} AS status, CASE WHEN {_FIRST} % 3 > 0 THEN CAST({_FIRST} % 11 AS INT) END AS first_hit_turn {_NODE}) AS t"
)
SCORES = (
    f"(SELECT CAST(event_id AS STRING) AS dialogue_id, CAST(event_id % 101 AS DOUBLE) AS node_completion, CAST(event_id * 7 % 101 AS DOUBLE) AS relation_score, CAST(event_id * 11 % 101 AS DOUBLE) AS knowledge_score, CAST(event_id * 13 % 101 AS DOUBLE) AS constraint_score, "
    f"CAST(event_id * 17 % 101 AS DOUBLE) AS soft_score, CAST(event_id % 5 AS INT) AS knowledge_worst, CAST({step(5)} % 5 AS INT) AS constraint_worst, CAST({step(3)} % 4 AS INT) AS missing_nodes, CAST({step(7)} % 3 AS INT) AS missing_required, 8 AS n_required, {flag(7)} AS context_problem FROM events) AS t"
)
BAD = f"(SELECT {DIALOGUE}, {pick(['low', 'medium', 'high', 'critical', 'odd'])} AS severity FROM events WHERE event_id % 11 = 0) AS t"
POSITIVE = (
    f"(SELECT CAST(event_id AS STRING) AS dialogue_id, {pick([95.0, 85.0, 82.0, 70.0])} AS total, {pick([90.0, 78.0, 70.0], 2)} AS node_completion, {pick([90.0, 60.0], 3)} AS relation_score, {pick([100.0, 97.0, 98.0], 5)} AS knowledge_score, {pick([100.0, 90.0], 7)} AS constraint_score, "
    f"{flag(2, 4)} AS scenario, CAST({step(11)} % 2 AS INT) AS n_bad, CAST({step(13)} % 2 AS INT) AS missing_nodes, CAST({step(17)} % 3 AS INT) AS missing_required, {flag(4, 19)} AS context_problem FROM events) AS t"
)
CANDIDATES = f"(SELECT CAST(event_id AS STRING) AS candidate_id, CASE WHEN event_id % 3 > 0 THEN CAST(event_id - event_id % 3 AS STRING) END AS merged_into FROM events) AS t"
RECORDED = f"(SELECT CAST(event_id AS STRING) AS candidate_id, {pick(VERDICTS, 3)} AS verdict, (event_id % 64) / 64e0 AS confidence FROM events WHERE event_id % 6 = 0) AS t"
FAMILIES = f"(SELECT {DIALOGUE}, {pick(FAMILY)} AS family FROM events WHERE event_id % 5 < 2) AS t"
CALLS = f"(SELECT {pick(['build', 'verify', 'repair'])} AS purpose, event_id % 100 AS prompt_tokens, event_id % 31 AS completion_tokens FROM events) AS t"
SAID = (
    f"(SELECT event_id AS id, {pick(['您知道', '好的', '嗯 ', '你说吧，', '先挂了，', '生效', '', '请问', '为什么要这样做呢，', '对'])} || {pick(['这个规则吗', '', '没有', '我在听', '你说也没用', '有没有 确认过', '我觉得不太合适吧是不是', '继续'], 10)} AS s FROM events) AS t"
)
ANSWERS = f"(SELECT event_id AS id, {pick(['Yes', '问题不成立', '不确定', '我认为', 'this is', 'looks like an ', None, '证据不足', 'safe', ' NO '])} || {pick(['', '问题成立', ' no issue', 'issue', '，待查', ' enough'], 10)} AS answer FROM events) AS t"
NAMES = f"(SELECT event_id AS id, {pick(['Flow', 'boundary', '', 'odd', None, 'x', '知识错误', ' context '])} AS name, {pick(['', '知识冲突', None, '上下文', '限制', 'requirement'], 8)} AS kind FROM events) AS t"
FOUND = (
    f"(SELECT {DIALOGUE}, CASE WHEN event_id % 8 < 5 THEN 'n' ELSE 'm' END AS node_id, CASE event_id % 8 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'e' WHEN 5 THEN 'a' WHEN 6 THEN 'b' WHEN 7 THEN 'c' ELSE 'd' END AS requirement_id, "
    f"{_FIRST} % 3 > 0 AS matched, CASE WHEN {_FIRST} % 3 > 0 OR {_FIRST} % 2 > 0 THEN CAST({_FIRST} % 7 AS INT) END AS turn_index FROM events GROUP BY user_id, event_id % 8) AS t"
)
ACTIVE_NODES = f"(SELECT {DIALOGUE}, 'n' AS node_id, {_FIRST} % 4 > 0 AS active FROM events GROUP BY user_id) AS t"
FLAT = f"(SELECT {pick(['r', 's'])} AS rule_id, user_id AS span_id, {pick([1.0, 0.01, 3.0, 2.0], 2)} AS weight, {flag(5)} AS is_role, {flag(3, 2)} AS is_hit, user_id % 9 AS n_pool_hits FROM events) AS t"
CONTEXT = (
    f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS policy_id, {pick(['触发但未处理', '已处理', '已处理但后续违背转场'])} AS status, CAST({step(3)} % 20 AS INT) AS trigger_turn, CASE WHEN event_id % 3 > 0 THEN CAST({step(3)} % 20 + event_id % 5 AS INT) END AS safe_turn FROM events WHERE event_id % 4 = 0) AS t"
)
TURNED = (
    f"(SELECT event_id AS id, {pick(['外卖价格', '这个', '规则', '网络', '堂食', '价格，'])} || {pick(['更低', '不适合您', '未生效', '没区别', '略高', '也可以'], 6)} || {pick(['，堂食更低', '', '，完全没用', '；已显示'], 36)} AS s, "
    f"{pick(['外卖价格', '', '套餐内容', '规则说明', '规则'], 5)} AS subject, {pick(['价格较高', '适合您', '已生效', '更流畅', '有帮助', '价格更低', '已显示'], 7)} AS expected FROM events) AS t"
)
LEDGER = f"(SELECT {DIALOGUE}, {pick(['k', 'c'])} AS family, {pick(['支持', '冲突', '证据不足', '安全', '别的', '未提及'], 3)} AS verdict, {pick(['次日 生效', '今天生效', '以后', '其他', ''], 2)} AS evidence FROM events WHERE event_id % 9 = 0) AS t"
ASKED = f"(SELECT CAST(event_id AS STRING) AS candidate_id, {DIALOGUE}, {pick(['k', 'c'], 2)} AS family, {pick(['次日生效', '今天 生效', '以后', '从未', '', '其他'])} AS evidence FROM events WHERE event_id % 4 = 1) AS t"
LABELS = (
    f"(SELECT CAST(event_id AS STRING) AS dialogue_id, {pick(['negative', 'negative', 'positive'])} AS sample_type, {pick(['我们 今天生效', '好', '保证收到'], 2)} AS said, {pick(['knowledge', 'knowledge_error', 'flow', '限制违规', 'constraint'])} AS error_family, {pick(['', 'k1'], 3)} AS knowledge_id, "
    f"{pick(['', 'c1'], 5)} AS constraint_id, {pick(['', 'n1'], 7)} AS node_id, {pick(['', 'r1'], 11)} AS requirement_id, {pick(['今天 生效', '不在', '', None], 13)} AS evidence_span, {pick(['保证收到', '', None], 17)} AS wrong_statement FROM events) AS t"
)
STEPS = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS node_id, {step(2)} % 4 > 0 AS active, (event_id % 128) / 128e0 AS score, {pick(['部分完成', '已完成', '缺失'])} AS status FROM events) AS t"
CHECKED = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS fact_id, {pick(['low', 'medium', 'high', 'critical'])} AS severity, {pick(['冲突', '支持', '证据不足'])} AS verdict FROM events WHERE event_id % 3 = 0) AS t"
LIMITED = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS constraint_id, {pick(['low', 'medium', 'high', 'critical'], 2)} AS severity, {pick(['违规', '安全'])} AS verdict FROM events WHERE event_id % 3 = 1) AS t"
PENALTIES = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS source, 'z' AS target, 'before' AS kind, CAST(event_id % 3 AS DOUBLE) AS penalty FROM events WHERE event_id % 5 = 2) AS t"
