"""Values that results must equal: word lists, patterns and constants, fixed as they stand."""

# fixed values: chunking
CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
BREAK_CHARS = "。！？\n；;"
HEADING = r"^#{1,6}\s*(.+?)\s*$"
KEY_VALUE = r"^([^：:]{2,12})[：:]\s*(.+)$"
AMOUNT_WITH_UNIT = r"\d+(?:\.\d+)?\s*(?:分钟|小时|工作日|自然日|天|日|%)"
QUESTION_LINE = r"^(?:Q|问)\s*[：:]\s*(.+)$"
ANSWER_LINE = r"^(?:A|答)\s*[：:]\s*(.+)$"

# fixed values: ontology
NODE_TYPES = ("Document", "Ticket", "Customer", "Product", "IssueCategory", "SLAClause", "Solution", "RootCause")
RELATIONS = {
    "MENTIONS": (("Document",), ("IssueCategory", "Product", "SLAClause", "Solution", "RootCause")),
    "CATEGORY_OF": (("Ticket",), ("IssueCategory",)),
    "SUBMITTED_BY": (("Ticket",), ("Customer",)),
    "ABOUT_PRODUCT": (("Ticket", "IssueCategory"), ("Product",)),
    "GOVERNED_BY": (("IssueCategory",), ("SLAClause",)),
    "SOLVED_BY": (("IssueCategory",), ("Solution",)),
    "CAUSED_BY": (("IssueCategory", "Ticket"), ("RootCause",)),
}

# fixed values: extraction
CATEGORY_KEYWORDS = {
    "物流配送": ("物流", "配送", "发货", "运输", "快递", "送达", "签收", "仓储", "运费"),
    "退款退货": ("退款", "退货", "退换", "退回", "驳回"),
    "保修维修": ("保修", "维修", "维保", "检修", "质保", "换新"),
    "发票计费": ("发票", "计费", "开票", "账单", "扣费", "对账", "结算"),
    "账户权限": ("账户", "账号", "权限", "登录", "密码", "实名", "子账号"),
    "续费签约": ("续费", "签约", "合同", "续约", "年费", "到期"),
    "技术支持": ("故障", "报错", "异常", "宕机", "无法使用", "崩溃"),
    "服务响应": ("响应", "受理", "工单", "客服", "投诉", "升级"),
}
SLA_TIME = r"(\d+)\s*(个)?\s*(分钟|小时|工作日|自然日|天)"
SLA_ACTIONS = (
    "响应", "回复", "受理", "处理", "解决", "修复", "送达", "赔付", "退款", "上门", "发货",
    "退货", "换货", "开具", "到账", "出库", "完成", "交付", "对账", "开票", "审核",
)
CLAUSE_MARKS = r"[，。；;：:、\n]"
SOLUTIONS = (
    "全额退款", "部分退款", "赔偿", "补偿", "换货", "重新发货", "重发", "免费维修",
    "优惠券", "代金券", "延期", "上门服务", "技术支持", "重新开票", "补发",
)
PRODUCT = r"([一-龥A-Za-z0-9]{0,8}(?:专业版|企业版|标准版|旗舰版|基础版|云服务|云平台))"
PRODUCT_WORDS = ("SLA", "CRM", "ERP", "OA", "SaaS", "PaaS", "API", "SDK", "VPN", "WMS", "TMS")
CAUSE = r"(?:原因(?:是|在于)?[：:]?|由于|因为|系因|根因[：:]?)\s*([^\n。；;，,]{2,24})"
CAUSE_TRIM = " 的了吗呢"
TICKET = r"((?:工单|订单|单号|案例)[^，。；\s]{0,12}?([A-Za-z]*\d{3,}))"
CUSTOMER = r"([一-龥A-Za-z]{2,12}(?:集团|公司|科技|有限公司|股份))"
EXTRACTION_CAPS = {"categories": 3, "sla": 5, "solutions": 4, "products": 4, "causes": 3, "tickets": 3, "customers": 3}
UNCATEGORISED = "未分类"

# fixed values: intents and actions
INTENTS = (
    ("request_refund", ("退款", "退钱", "申请退", "返还", "退给我")),
    ("update_order", ("改地址", "修改地址", "改收货", "改单", "改期", "改送达", "延迟送达")),
    ("create_ticket", ("建工单", "创建工单", "开工单", "提工单", "报障", "投诉", "上报")),
)
ORDER_ID = r"\b([A-Z]{2,4}[-_]?\d{3,12})\b"
URGENT_WORDS = ("紧急", "严重", "业务中断", "全挂")
SERIOUS_WORDS = ("高危", "降级", "很慢")
DATE_WORDS = ("改期", "送达", "延迟", "日期", "时间")
TICKET_SLA = {"P0": "15 分钟", "P1": "1 小时", "P2": "4 小时"}
FIELD_LABELS = {"address": "收货地址", "delivery_date": "期望送达日期"}

# fixed values: live lookups and the critic
ORDER_WORDS = ("订单", "物流", "发货", "快递")
STOCK_WORDS = ("库存", "有货", "现货", "sku", "SKU")
ORDER_PROMPT = "请提供订单号以查询实时状态"
STOCK_PROMPT = "请提供 SKU 以查询实时库存"
LIVE_HINTS = ("订单", "物流", "快递", "发货", "到货", "库存", "现货", "有货", "单号", "签收")
GRAPH_HINTS = ("关系", "关联", "适用于", "哪条", "多跳", "同一", "根因", "影响", "依赖")
RETRYABLE_4XX = (408, 429)

# fixed values: answers and their evaluation
SECTIONS = {"actions": "【执行动作】", "live": "【实时数据】", "paths": "【关系路径】", "knowledge": "【知识依据】"}
NOTHING_FOUND = "未在知识库中找到相关片段，建议补充知识或转人工客服。"
NUMERALS = {"零": "0", "一": "1", "两": "2", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
UNIT_ALIASES = (
    ("个自然日", "日"),
    ("个工作日内", "工作日"),
    ("自然日", "日"),
    ("天内", "日"),
    ("个小时", "小时"),
    ("小时内", "小时"),
    ("天", "日"),
)
PASS_RECALL = 0.6
