"""Every knob of a conversion, as literals that plan builders read."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Names and defaults of the options.


@dataclass(frozen=True)
class Options:
    outputs: tuple[str, ...] = ("md",)
    mdFlavor: str = "gfm"
    frontMatter: bool = True
    bulletMarker: str = "-"
    headingStyle: str = "atx"
    codeBlockStyle: str = "fenced"
    linkStyle: str = "inlined"
    wrap: int = 0
    pdfHeadings: bool = True
    pdfTables: bool = True
    pdfColumns: str = "auto"
    stripRunningHeads: bool = True
    pageMarkers: str = "comment"
    pdfLinks: bool = True
    ocrMode: str = "auto"
    ocrLang: str = "eng"
    ocrResolution: str | int = "auto"
    ocrPreprocess: str = "off"
    ocrRescue: bool = True
    ocrDetail: str = "summary"
    ocrParameters: str = "default"
    ocrMinChars: int = 24
    imageMode: str = "embed"
    maxImageBytes: int = 4 * 1024 * 1024
    sheetMode: str = "table"
    maxSheetRows: int = 5000
    includeEmptySheets: bool = False
    includeSpeakerNotes: bool = True
    readability: bool = True
    repairStructure: bool = True
    validate: bool = True
    reviewMarkers: bool = True

    def but(self, **changes) -> Options:
        """The same options with some changed; unknown names raise."""
        return replace(self, **changes)

    def changed(self) -> dict:
        """Options that aren't at their defaults."""
        plain = Options()
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != getattr(plain, f.name)}
