"""Parser notices as readers see them: routine ones are hidden, families are unified, the rest stays (FLT17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The messages that existing records hold.
ROUTINE = (
    r"文本中的不可见空字符已替换为空格；原文件保留。",
    r"PDF 表格按原页保留；跨页表头和脚注需结合相邻页读取。",
    r"OCR 识别文字未经人工核对；表格结构与图形语义可能不完整，关键数字请核对原文件。",
    r"Word (?:文本框内容已收录|内容控件内容已收录)（[0-9]+ (?:个文本框|处)），版面位置(?:可能)?与原文件不同。",
    r"Word [0-9]+ 张内容图已生成 AI 摘要；图中细节请核对原文件。",
    r"Excel [0-9]+ 张内容图片已生成 AI 转述；细节请核对原文件。",
    r"工作表“.+”保留公式与已有缓存结果，未重新计算公式。",
    r"(?:PPT|PDF) [0-9]+ 页视觉内容已生成 AI 转述；细节请核对原文件。",
    r"PDF [0-9]+ 页扫描正文采用 OCR 提取；未调用视觉 API。",
    r"PDF 第 [0-9]+ 页为扫描页，已 OCR 识别；关键数字请核对原文件。",
    r"PDF 已生成 [0-9]+ 个视觉分区转写，[0-9]+ 页全部分区完成且未发现数字线索遗漏；细节请核对原文件。",
    r"图片(?:正文已完成 OCR 提取|已完成 OCR 和 AI 转述；细节请核对原文件)。",
    r"视觉分区处理已保存进度，排队继续处理。",
    r"执行器重载，自动重新排队。",
)
DRAWING = (
    r"PDF 第 [0-9]+ 页按图纸建立检索索引；图名、图号、说明和明细请结合原图核对，不转述全图尺寸。",
    r"CAD 索引范围仅限原生文字和块属性；图形及精确尺寸关系请以原图为准。",
    r"图纸检索线索，须结合原图读取；不用于确定尺寸、几何关系或工程结论。",
)
REVISION = r"Word 含修订记录，已按当前正文收录插入内容并排除删除内容；历史修订请查看原文件。"
STORED = r"此格式仅保存原文件，暂无正文索引；旧 Office 请另提交 \.docx/\.xlsx/\.pptx，CAD／模型包请关联说明或参数文件。"
DRAWING_NOTICE = "图纸已建立检索索引；尺寸和结构请结合原图查看。"
REVISION_NOTICE = "文件含修订记录，已按当前正文读取。"
STORED_NOTICE = "此格式仅保存原件，暂不提供正文检索。"


def any_of(patterns: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(patterns) + ")$"


def public(messages: Column) -> Column:
    """Null arrays become empty; order is kept and repeated notices appear once."""
    shown = F.filter(F.coalesce(messages, F.array().cast("array<string>")), lambda m: ~m.rlike(any_of(ROUTINE)))
    unify = lambda m: (
        F.when(m.rlike(any_of(DRAWING)), DRAWING_NOTICE).when(m.rlike(any_of((REVISION,))), REVISION_NOTICE).when(m.rlike(any_of((STORED,))), STORED_NOTICE).otherwise(m)
    )
    return F.array_distinct(F.transform(shown, unify))


#: Status by notices and chunks (SRC01): what the warning must contain for ``partial``.
PARTIAL = ("未解析", "未完整解析", "未解释", "OCR", "未纳入")


def status(chunks: Column, warnings: Column, known: Column) -> Column:
    """``stored_only`` for unknown formats, ``failed`` without chunks, ``partial`` by the warnings, else ``ready``."""
    partial = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike("|".join(PARTIAL)))
    return F.when(~known, "stored_only").when(chunks == 0, "failed").when(partial, "partial").otherwise("ready")
