"""Fixed values of the document operators: words and patterns that results depend on."""

#: Lines that are headers or footers as a whole.
BOILERPLATE_LINES = (
    r"^固收研究\s*$", r"^固定收益研究\s*$", r"^金融工程研究\s*$", r"^证券研究报告\s*$", r"^深度研究\s*$", r"^华泰证券\s*$", r"^HUATAI\s*SECURITIES\s*$", r"^HAITONG\s*$",
    r"^海通证券\s*$", r"^中信证券\s*$", r"^中金公司\s*$", r"^国泰君安\s*$", r"^招商证券\s*$",
    r"^免责声明和披露以及分析师声明是报告的一部分[，,].*请务必一起阅读[。.]?\s*\d*\s*$", r"^请务必阅读正文之后的信息披露和法律声明\s*$", r"^请仔细阅读本报告末页声明\s*$",
    r"^本报告仅供.*参考\s*$", r"^[-—–\s]*\d{1,3}[-—–\s]*$", r"^第\s*\d+\s*页\s*(共\s*\d+\s*页)?\s*$", r"^\d+\s*/\s*\d+\s*$",
)
#: Texts that mark a short line as a disclaimer or brand.
BOILERPLATE_MARKS = ("免责声明和披露以及分析师声明是报告的一部分", "请务必一起阅读", "请务必阅读正文之后", "HUATAI SECURITIES", "HUATAI SECURITES")
#: Table cells that are brands or disclaimers.
BOILERPLATE_CELLS = ("HAITONG", "海通证券", "金融工程研究", "证券研究报告", "金融工程专题报告", "固收研究")
BOILERPLATE_CELL_STARTS = ("请务必阅读正文之后", "免责声明和披露")
CONTAMINATED = ("HAITONG", "海通证券", "证券研究报告", "金融工程研究")
GARBAGE = ("收孟", "波暗", "W撒", "因于IC", "超收盖", "温价率", "讨级")
TOTALS = ("合计", "总计", "总额", "小计", "total", "sum", "subtotal")
STATEMENTS = {
    "income_statement": (
        "营业收入", "营业总收入", "主营业务收入", "营收", "营业成本", "主营业务成本", "营业总成本", "毛利", "毛利率", "销售毛利率", "营业利润", "利润总额", "净利润", "归母净利润",
        "扣非净利润", "净利率", "销售净利率", "基本每股收益", "稀释每股收益", "每股收益", "销售费用", "管理费用", "研发费用", "财务费用", "期间费用", "EBIT", "EBITDA",
    ),
    "balance_sheet": (
        "资产总计", "资产总额", "总资产", "负债总计", "负债总额", "总负债", "所有者权益合计", "股东权益合计", "净资产", "归母净资产", "流动资产合计", "非流动资产合计",
        "流动负债合计", "非流动负债合计", "货币资金", "应收账款", "存货", "固定资产", "无形资产", "商誉", "短期借款", "长期借款", "应付账款", "资产负债率", "流动比率", "速动比率", "产权比率",
    ),
    "cash_flow": (
        "经营活动现金流", "经营活动产生的现金流量净额", "经营活动现金流量净额", "投资活动现金流", "投资活动产生的现金流量净额", "投资活动现金流量净额", "筹资活动现金流",
        "筹资活动产生的现金流量净额", "筹资活动现金流量净额", "现金净增加额", "现金及现金等价物净增加额", "期末现金余额", "期末现金及现金等价物余额", "自由现金流", "FCF", "现金流量表",
    ),
}
GLOSSARY = {
    "营业收入": "营收", "主营业务收入": "营收", "主营业务成本": "营业成本", "总营业收入": "营业总收入", "总营业成本": "营业总成本", "营业毛利": "毛利", "销售毛利率": "毛利率",
    "营业毛利率": "毛利率", "销售净利率": "净利率", "营业净利率": "净利率", "营业利润额": "营业利润", "税前利润": "利润总额", "税后利润": "净利润",
    "归属于母公司股东的净利润": "归母净利润", "归属于上市公司股东的净利润": "归母净利润", "归属于母公司所有者的净利润": "归母净利润", "扣除非经常性损益后的净利润": "扣非净利润",
    "归属于上市公司股东的扣除非经常性损益的净利润": "扣非净利润", "归属于上市公司股东的扣除非经常性损益后的净利润": "扣非净利润", "EBIT": "息税前利润", "EBITDA": "息税折旧摊销前利润",
    "资产总额": "总资产", "资产总计": "总资产", "负债总额": "总负债", "负债总计": "总负债", "所有者权益合计": "净资产", "股东权益合计": "净资产",
    "归属于母公司所有者权益合计": "归母净资产", "归属于母公司股东权益合计": "归母净资产", "银行存款及现金": "货币资金", "应收账款净额": "应收账款", "存货净额": "存货",
    "固定资产净额": "固定资产", "无形资产净额": "无形资产", "商誉净额": "商誉", "短期贷款": "短期借款", "长期贷款": "长期借款", "应付账款总额": "应付账款",
    "经营活动产生的现金流量净额": "经营活动现金流", "经营活动现金流量净额": "经营活动现金流", "投资活动产生的现金流量净额": "投资活动现金流", "投资活动现金流量净额": "投资活动现金流",
    "筹资活动产生的现金流量净额": "筹资活动现金流", "筹资活动现金流量净额": "筹资活动现金流", "现金及现金等价物净增加额": "现金净增加额", "期末现金及现金等价物余额": "期末现金余额",
    "FCF": "自由现金流", "营业费用": "销售费用", "行政管理费用": "管理费用", "研发支出": "研发费用", "研究开发费用": "研发费用", "利息支出及手续费": "财务费用", "三费合计": "期间费用",
    "净资产收益率": "ROE", "加权平均净资产收益率": "ROE", "全面摊薄净资产收益率": "ROE", "总资产收益率": "ROA", "总资产报酬率": "ROA", "负债比率": "资产负债率",
    "流动资产/流动负债": "流动比率", "速动资产/流动负债": "速动比率", "负债权益比率": "产权比率", "存货周转次数": "存货周转率", "应收账款周转次数": "应收账款周转率",
    "总资产周转次数": "总资产周转率", "每股收益": "EPS", "基本每股收益": "EPS", "稀释每股收益": "EPS", "每股净资产": "BPS", "市盈率": "PE", "滚动市盈率": "PE_TTM",
    "市盈率(TTM)": "PE_TTM", "市盈率（TTM）": "PE_TTM", "市净率": "PB", "市销率": "PS", "企业价值/息税折旧摊销前利润": "EV_EBITDA",
}
METRICS = (
    "营业收入", "营收", "营业成本", "毛利润", "净利润", "归属于母公司股东的净利润", "归属于上市公司股东的净利润", "归属于母公司所有者的净利润", "归母净利润", "扣除非经常性损益后的净利润",
    "归属于上市公司股东的扣除非经常性损益的净利润", "扣非净利润", "扣非", "基本每股收益", "稀释每股收益", "总资产", "归母净资产", "负债合计", "流动资产合计", "经营活动现金流净额",
    "投资活动现金流净额", "销售毛利率", "毛利率", "净资产收益率", "加权平均净资产收益率", "ROE", r"市盈率(?:\(TTM\)|\（TTM\）)?", "滚动市盈率", r"PE(?:_TTM)?", "TTM",
)
CURRENCY = r"(?:(?:¥|￥|RMB|CNY|USD|\$)\s*)?"
PERIOD = r"(?:\d{4}\s*(?:年)?\s*(?:H[12]|Q[1-4])?\s*[:：]?\s*)?"
PLAIN_NUMBER = r"[+-]?\d+(?:[,、]\d{3})*(?:\.\d+)?"
ANY_NUMBER = rf"{PLAIN_NUMBER}|\({PLAIN_NUMBER}\)|（{PLAIN_NUMBER}）"
NUMBER_UNIT = r"亿元|万元|万|元|%\s*(?:同比|环比|YoY|QoQ)?|同比|环比|YoY|QoQ"
VERBS = "同比增长|环比增长|同比下降|同比减少|同比下滑|同比\\+|同比|环比|增长|上升|增加|下降|下滑|减少"
RISES, FALLS = ("增长", "上升", "增加"), ("下降", "下滑", "减少")
DIAGRAMS = (
    "graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "requirementDiagram", "gitGraph", "C4Context", "mindmap", "timeline", "sankey-beta",
)
