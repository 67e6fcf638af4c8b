"""The naming contract as data (STR16)."""

# Fixed values of the naming contract: they must equal the published ones for the same names to be accepted.
LONGEST = 240
LANGUAGES = ("ZH", "EN", "ES", "RU", "FR", "PT", "ZH-EN", "ZH-ES", "ZH-RU", "ZH-FR", "ZH-PT")
#: Parts that name a language otherwise; they may stand nowhere.
OTHER_LANGUAGE_NAMES = ("中文", "英文", "法语", "西语", "俄语")
EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "csv", "json", "png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff", "dwg", "dxf", "mp4", "mov", "avi", "mkv", "webm", "step", "stp", "stl", "obj", "glb",
    "gltf", "3mf",
)
PLACEHOLDERS = ("未知", "待定", "待确认", "待核对", "未命名", "新建文件", "新建文档", "对象", "项目", "客户", "产品", "unknown", "untitled", "tbd")
BUSINESS_TYPES = (
    "公司介绍", "产品宣传册", "宣传册", "画册", "产品图片", "宣传图片", "展示模型", "对外案例", "询盘", "客户需求", "询盘分析报告", "客户背调", "沟通纪要", "市场研究", "客户报价单", "销售合同", "供货范围", "商务协议", "技术方案",
    "工艺技术方案", "参数表", "技术参数表", "设备清单", "工艺设备表", "公用工程消耗清单", "负荷清单", "技术规范", "功能规范", "设计依据", "图纸", "工程图纸", "总装图", "装配图", "零件图", "布置图", "平面布置图", "总平面布置图",
    "工艺流程图", "总工艺流程图", "工艺仪表流程图", "工艺布置图", "供应商报价", "比价表", "采购合同", "制造记录", "检验报告", "验货记录", "试验报告", "装箱单", "商业发票", "提单", "报关单", "操作手册", "维护手册", "故障案例",
    "售后报告", "标准", "SOP", "报价模板", "培训计划", "培训材料", "经营报表", "管理制度", "预算", "会议纪要", "问题与核心诉求汇总", "Equipment List", "Scope of Works", "Scope of Work", "Basis of Design", "Process Flow Diagram",
    "Product Catalogue", "Technical Specification", "Performance Guarantee Requirements", "HSE Requirements",
)
# Objects that say nothing, dates and versions; they too must equal the published contract.
GENERIC_OBJECT = r"(?i)^(drawing\s*[0-9]*|图纸\s*[0-9]*|新建(文档|文件)|scan\s*[0-9]*|image\s*[0-9]*)$"
DATE, VERSION = r"^(19|20)[0-9]{6}$", r"(?i)^[VR][0-9]{1,3}$"
