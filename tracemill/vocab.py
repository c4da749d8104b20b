"""Word lists and patterns used as defaults. Operators take a `Vocabulary`, so other languages pass their own.

Everything in this module is a fixed value that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: message cleaning ---------------------------------------------------------------------------------
NOISE_TAGS = (
    "environment_context", "app-context", "permissions instructions", "filesystem", "workspace_roots", "multi_agent_mode",
    "plugins_instructions", "skills_instructions", "collaboration_mode", "response-annotations", "image_resize_notice",
    "developer", "system", "model_switch", "turn_aborted", "task_aborted", "task_complete", "item_completed",
    "codex_internal_context",
)
SYSTEM_LINE_PREFIXES = (
    "# Files mentioned", "# Response annotations", "<image", "</image", "Distinguish instructions", "<filesystem",
    "<workspace_roots", "<root>", "<permission_profile", "<permissions", "## My request:",
)
META_PREFIXES = (
    "any running unified exec processes", "the user interrupted the previous turn", "computer use is not allowed",
    "script completed wall time",
)
INJECTED_PREFIXES = ("[System:", "[OUT-OF-BAND", "@image")

# --- fixed values: text of nested payloads, first key first ----------------------------------------------------------
VISIBLE_KEYS = ("text", "output", "result", "message", "value", "content", "summary")
PAYLOAD_KEYS = ("content", "output", "result", "arguments", "input", "item")
# An envelope starts in the first characters of a text that is not long; so many are opened inside each other.
ENVELOPE_START, ENVELOPE_LENGTH, ENVELOPES = 240, 20000, 3

# --- fixed values: attachments of a message --------------------------------------------------------------------------
ATTACHED = (
    r"(?is)# Response annotations:.*?(?=## My request:|\z)",
    r"(?is)# Files mentioned by the user:.*?(?=## My request:|\z)",
    r"!\[[^\]]*\]\([^)]*\)",
    r"(?i)<[^>]{0,120}(?:cwd|current_date|timezone|workspace|permission)[^>]*>",
    r"(?iU)/var/folders/[^\s)]+codex-clipboard-[^\s)]+",
    r"(?iU)\bcodex-clipboard-[\w.-]+",
)
REQUEST_LABEL = "## My request:"
UNCLOSED_TAGS = ("environment_context", "app-context")
SKIPPED_NAMES = (".DS_Store", "COMMIT_EDITMSG", "FETCH_HEAD", "HEAD")
SKIPPED_PATHS = (r"[/\\]\z", r"(^|/)\.git(/|\z)", r"[${}]|GATE_|VAULT/", r"^(a/|b/|tmp/|/tmp\}/)", "…|codex-clipboard", "^http")

# --- fixed values: session summaries --------------------------------------------------------------------------------
CORRECTION_MARKERS = (
    "不是", "不对", "没解决", "没有解决", "还是不行", "还是不好", "没用", "卵用", "别假装", "不能算", "不够", "你说得对",
    "感觉还是", "做错了", "搞错了", "不正确", "不应该", "我的意思是", "我是觉得", "不一定非要", "重点应该", "不必局限",
    "别只", "不只是",
)
OPEN_MARKERS = (
    "未完成", "尚未完成", "还没完成", "还未完成", "待办", "仍然", "还没", "还未", "无法", "未验证", "不确定", "待确认",
    "缺少", "缺失", "风险", "阻塞", "卡住", "仍在失败", "仍然失败", "还在报错", "未解决",
)
DECISION_PATTERNS = (
    "决定", "选择", "采用", "改成", "改为", "最终(?:决定|选择|采用|结论)", "结论(?:是|为)", "保留", "移除", "删除",
    "不再(?:使用|依赖|调用|运行|采用|保留)", "只读(?:模式|探测|检查|核对)",
)
RESULT_PATTERNS = (
    "已(?:完成|修复|验证|生成|写入|安装|部署|更新|重建|重载|切换|提交|推送)",
    "(?:测试|门禁|仿真|用例|命令|脚本|发布|构建|检查).{0,16}(?:通过|成功|失败)",
    r"\bpass(?:ed)?\b", "all .*passed", "exit(?:ed)? (?:with )?(?:code )?0", "returncode[\"']?\\s*[:=]\\s*0",
    "根因(?:是|为)?", "失败(?:原因)?", "错误(?:是|为)(?!否)", "结论(?:是|为)",
)
PLAN_WORDS = (
    "(?:接下来|下一步|下步|随后|然后|稍后|之后会|我会|我们会|我将|我们将|我准备|打算|计划|如果.*(?:就|会)|"
    "需要进一步|建议下一步)"
)
PLAN_START = (
    "^(?:接下来|下一步|下步|然后|随后|稍后|先(?:只读|检查|做|跑|确认|核对)?|现在我(?:会|在)|最后我(?:会|将)|"
    "目前我(?:会|在)|我(?:会|将|准备|继续|再|先|打算|计划))"
)
PROCESS_PREFIXES = (
    "我先", "我现在", "下一步", "接下来", "我会", "可以，", "可以直接", "好的，我", "好，我", "先检查", "正在", "我准备",
    "现在我会", "现在我在", "目前我在",
)
STILL_OPEN = "仍然|还没|还未|尚未|未解决|待确认|未验证|无法"
PAST_START = "^(?:之前|以前|原先|本来)"
DONE_START = "^(?:我已|我们已|已经|已|确认)"
SENTENCE_BREAK = "(?<=[。！？!?；;])|(?:但|不过)"
SENTENCE_EDGE = " -•*，,、；;。.!?！？\n"
FAILURE_WORD = "失败"
LATEST_REQUEST_LABEL = "当前请求："
UNKNOWN_PROJECT = "未识别项目"
PATH_PATTERN = (
    "(?i)(?:(?:/Users|/Volumes|/tmp|/var/folders|~/|\\.\\.?/)[^\\s`<>\"'|)\\],;]+|"
    "(?:[\\w./-]+/)(?:[^\\s`<>\"'|)\\],;]+\\.(?:py|sh|md|jsonl?|db|png|html|toml|yaml|yml|log|txt)))"
)
PATH_STOPS = "(?U)[\\s`<>\"'|)\\],;]+"
VERIFY_DENIED = (
    "not allowed", "unavailable", "permission denied", "operation not permitted", "traceback", "command failed",
    "process exited with code [1-9]\\d*", "^\\s*exit_code\\s*[:=]\\s*[1-9]\\d*\\b", "^\\s*returncode\\s*[:=]\\s*[1-9]\\d*\\b",
    "不允许", "不可用", "没有权限", "权限被拒绝", "执行失败", "运行失败",
)
VERIFY_PASSED = (
    "^\\s*(?:✅|✔|pass(?:ed)?|ok)\\b[^\\n]{0,100}", "^\\s*(?:all [^\\n]*passed|\\d+\\s+tests?\\s+passed|\\d+\\s+passed\\b)",
    "process exited with code 0\\b", "^\\s*exit_code\\s*[:=]\\s*0\\b", "window:.*app:", "ax output",
    "^\\s*四层[^\\n]{0,20}通过\\s*$", "^\\s*运行态仿真(?:全部)?通过\\s*$", "^\\s*门禁通过\\s*$", "^\\s*全部通过\\s*$",
    "^\\s*测试通过\\s*$",
)

# --- fixed values: daily work and noise -----------------------------------------------------------------------------
CONCLUSION_SIGNALS = (
    "✅", "完成", "修复", "根因", "结论", "决定", "搞定", "已改", "已删", "总结", "结果是", "真因", "降级", "失败原因",
    "落地", "收尾",
)
AD_STRONG = (
    "(ad)", "职位推荐", "前程无忧", "智联招聘", "58同城", "boss直聘", "拉勾", "【免费直播】", "直播预告",
)
AD_WEAK = ("unsubscribe", "退订", "取消订阅", "edm", "邮件营销")
MAIL_STRUCTURE = (
    "(?i)(<(?:html|body|table|div|a\\s|img|br|/?p|span|font)[^>]*>|<!doctype|&nbsp;|href=|发件人|收件人|此邮件|群发邮件|"
    "点击查看|点击这里|如果您(?:不|无)?希望|click here|this (?:e-?mail|message)|no longer wish to receive|"
    "manage your preferences|view in browser)"
)
HTML_CSS = "(?i)<(html|body|div|table|img|style)[^>]*>|\\.ql-align|background-color:|font-family:|margin:0"
DENOISED_MARK = "[广告/订阅邮件，已降噪]"
PROBE_PHRASES = ("reply with exactly", "回复一个字", "ok-kimi", "ok-ark", "一个字", "只回复")
OWN_CALL_MARK = "[daily-summary-polish]"
OWN_CALL_SOURCE = "daily-polish"
OWN_SOURCES = "^(skill-evolution-|preference-miner)"
SKIP_SOURCES = ("cron", "daily-polish", "skill-evolution-librarian", "preference-miner", "tool")

# --- fixed values: user signals and outcomes ------------------------------------------------------------------------
USER_CORRECTION = (
    "不对", "错了", "不是", "别这样", "不要这样", "重新", "重来", "太长", "太短", "怎么又", "又错", "还是不行", "没对",
    "搞反", "反了", "我不是这个意思", "形式主义", "摸鱼", "忽悠", "假的", "你确定", "真的吗", "别急着", "不要急", "太啰嗦",
    "说重点", "简单点", "别扩", "别加戏", "过度", "想多了", "删了", "停", "先别", "不是让你", "谁让你", "我只是问问",
    "我只是说",
)
USER_APPROVAL = (
    "对", "就这样", "可以", "好的", "不错", "完美", "正是", "就是这", "准确", "谢谢", "辛苦", "👍", "❤️", "😂", "漂亮",
    "靠谱", "稳", "牛", "太好了",
)
USER_HABIT = (
    "必须", "一定要", "记住", "以后都", "每次都", "老规矩", "按.{0,6}来", "不要[飞系]", "静默", "零 ?token", "别推",
    "不要打扰", "发飞书", "红涨绿跌", "最小改动", "整套",
)
CLOSING_SUCCESS = ("✅", "完成", "搞定", "已修复", "解决了", "全部完成", "done", "fixed", "resolved")
CLOSING_STRONG = ("✅", "全部完成", "搞定", "已修复")
CLOSING_FAIL = (
    "失败", "没搞定", "无法", "放弃", "中断", "interrupted", "超时", "卡住", "timed out", "failed", "give up",
)
REACTION_APPROVE = (
    "谢谢", "辛苦", "👍", "❤️", "完美", "搞定了", "可以了", "太好了", "nice", "thanks", "great", "满意", "对了！", "漂亮",
)
REACTION_APPROVE_ANY_CASE = ("nice", "thanks", "great")
REACTION_COMPLAIN = (
    "不对", "没用", "怎么又", "还是有问题", "错了", "重新来", "什么鬼", "搞砸", "又崩", "不行啊", "别忽悠", "假成功",
    "wrong", "still broken",
)
REACTION_COMPLAIN_ANY_CASE = ("wrong", "still broken")
TAIL_SUCCESS = ("✅", "完成", "搞定", "已修复", "解决了", "成功", "全部完成", "已完成", "落地")
TAIL_FAIL = (
    "失败", "没搞定", "无法", "放弃", "报错", "中断", "interrupted", "超时", "timed out", "未完成", "卡住", "翻车",
)

# --- fixed values: errors -------------------------------------------------------------------------------------------
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "on", "at", "for", "with", "by", "and", "or", "not",
    "no", "it", "this", "that", "be", "been", "has", "have", "had", "from", "as", "but", "的", "了", "在", "是", "和",
    "与", "或", "被", "把", "让", "使", "一个", "没有", "不", "未", "也", "都", "就", "时", "中",
)
PLACEHOLDERS = (
    ('"[^"]{8,}"', '"STR"'),
    ("'[^']{8,}'", "'STR'"),
    ("`[^`]{4,}`", "`CODE`"),
    (r"(?:/[\w.\-一-鿿]+){2,}/?", "/PATH"),
    (r"[A-Za-z]:\\(?:[\w.\-]+\\)+[\w.\-]*", "WINPATH"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "DATETIME"),
    (r"\d{4}-\d{2}-\d{2}", "DATE"),
    (r"\d{2}:\d{2}(:\d{2})?", "TIME"),
    ("0x[0-9a-fA-F]+", "HEX"),
    (r"\b[0-9a-fA-F]{8,}\b", "HEX"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"\b(?:pid|PID)\s*[=:]?\s*\d+", "pid=NUM"),
    (r"\b\d{1,3}(\.\d{1,3}){3}(:\d+)?\b", "IP"),
    (r":\d{2,5}\b", ":PORT"),
    (r"\bv?\d+(\.\d+){1,3}\b", "VER"),
    (r"\b\d{2,}\b", "NUM"),
)
GENERIC_HEADINGS = ("摘要", "summary", "事件经过", "修复", "相关链接", "背景", "问题", "解决方案")
FAIL_HINT = (
    "(?i)失败|报错|翻车|断网|断连|挂掉|踩坑|反思|教训|没粘住|错误|修复|排查|兜底|fail|error|fix|fatal|exception|timeout|"
    "interrupted"
)
BANNER = r"(?i)^(?:Hermes Agent\s+v?\d|[-=─━]{3,}|upstream\s+[a-f0-9]+)"
NOT_INCIDENT_NAME = "会话总结|架构图|方案|总结-"
NOT_FAILURE_TEXT = "会话总结|架构图|总结[-—]"
LOG_FAILURE_LINE = r"(?i)\[(\d{4}-\d{2}-\d{2})[  ][\d:]+\]\s*(.*(?:FAIL|失败|ERROR|rc=[1-9]).*)"
TOOL_ERROR_LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ WARNING.*?agent\.tool_executor: Tool (\w+) returned error.*?:\s*(.*)$"
)
TOOL_FAILURE = r'(?i)"success"\s*:\s*false|exit_code["\s:]+-?[1-9]|Traceback \(most recent'

# --- fixed values: notes --------------------------------------------------------------------------------------------
SKIP_DIRECTORIES = (".obsidian", ".checkpoints", ".trash")
GENERATED_NOTES = ("TIMELINE.md", "INDEX.md", "README.md", "ERRORS.md", "LEARNINGS-REVIEW.md")
SUMMARY_HEADING = "摘要"
WORK_HEADINGS = "完成内容|完成工作"
DELIVERABLES_HEADING = "产出物"
RESERVED_AREAS = ("preferences", "incidents", "daily")
PREFERENCE_WORDS = "(?i)我喜欢|我的偏好|我习惯|我从不|我总是|preference|我以后"
INCIDENT_WORDS = "(?i)出错了|失败了|报错|解决|修复|踩坑|bug"
UNKNOWN_DATE = "未知日期"

# --- fixed values: proposals, reviews, retrieval --------------------------------------------------------------------
ESSENTIAL_SKILLS = ("hermes-agent",)
SELF_PREFIXES = ("user",)
RETIRE_EXTRA_PREFIX = "auto-skill-save"
CLUSTER_FOR_TARGET = (
    ("cron-exit1-triage", "script exited code"),
    ("cron-shutdown-interrupt-recovery", "interrupted shutdown"),
    ("zh-copy-preflight", "typo"),
    ("systematic-debugging", "terminal"),
    ("hermes-agent", "env"),
    ("hermes-custom-providers", "env"),
    ("hermes-plugin-automation", "script exited code"),
    ("macos-power-management", "interrupted shutdown"),
)
REPLY_KINDS = ("new_skill", "enhance", "retire", "fix_reference", "repair")
REPLY_PARTS = ("理由", "证据", "动作")
PREFERENCE_PARTS = ("规则", "证据", "为什么")
REPLY_HEADING = "技能提案"
APPROVED_SECTION = "已批准待执行"
REVIEW_CHECKS = ("A1", "A2", "S1", "S2", "E1", "G1", "R1", "M1", "T1")
REVIEW_STATUSES = ("pass", "finding", "insufficient_data", "not_applicable")
EVIDENCE_LEVELS = ("user_explicit", "verified_outcome", "unverified")
OUTCOMES = ("failed", "unknown", "user_accepted", "verified_success")
RECALL_WEIGHTS = (
    ("project", 40), ("title", 24), ("goal", 18), ("claims", 4), ("verified", 20), ("open_items", 12), ("decisions", 24),
    ("corrections", 32),
)
UNIT_FIELDS = (
    ("corrections", "correction", "user_correction_candidate"),
    ("decisions", "decision", "extracted_decision_unverified"),
    ("verified", "verified", "tool_output_signal_not_task_success"),
    ("goal", "goal", "user_request"),
    ("open_items", "open_item", "unresolved_candidate"),
    ("claims", "claim_unverified", "assistant_claim_unverified"),
)
KIND_BONUS = (
    ("correction", 0.035), ("verified", 0.025), ("decision", 0.015), ("experience", 0.02), ("claim_unverified", -0.06),
)
# --- end of fixed values --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """The word lists an operator may be asked to swap. Plain words unless the field says pattern."""

    correction: tuple[str, ...] = USER_CORRECTION
    approval: tuple[str, ...] = USER_APPROVAL
    habit_patterns: tuple[str, ...] = USER_HABIT
    closing_success: tuple[str, ...] = CLOSING_SUCCESS
    closing_strong: tuple[str, ...] = CLOSING_STRONG
    closing_fail: tuple[str, ...] = CLOSING_FAIL
    reaction_approve: tuple[str, ...] = REACTION_APPROVE
    reaction_approve_any_case: tuple[str, ...] = REACTION_APPROVE_ANY_CASE
    reaction_complain: tuple[str, ...] = REACTION_COMPLAIN
    reaction_complain_any_case: tuple[str, ...] = REACTION_COMPLAIN_ANY_CASE
    tail_success: tuple[str, ...] = TAIL_SUCCESS
    tail_fail: tuple[str, ...] = TAIL_FAIL
    conclusion: tuple[str, ...] = CONCLUSION_SIGNALS
    ad_strong: tuple[str, ...] = AD_STRONG
    ad_weak: tuple[str, ...] = AD_WEAK
    probes: tuple[str, ...] = PROBE_PHRASES
    correction_markers: tuple[str, ...] = CORRECTION_MARKERS
    open_markers: tuple[str, ...] = OPEN_MARKERS
    decision_patterns: tuple[str, ...] = DECISION_PATTERNS
    result_patterns: tuple[str, ...] = RESULT_PATTERNS
    plan_words: str = PLAN_WORDS
    plan_start: str = PLAN_START
    process_prefixes: tuple[str, ...] = PROCESS_PREFIXES
    sentence_break: str = SENTENCE_BREAK
    sentence_edge: str = SENTENCE_EDGE
    preference_words: str = PREFERENCE_WORDS
    incident_words: str = INCIDENT_WORDS


DEFAULT = Vocabulary()
