"""Names, places and limits of an install, as one value that plans and sources take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    # What an install's files are called.
    root_manifest: str = "pkg_version"
    audio_prefix: str = "Audio_"
    manifest_suffix: str = "_pkg_version"
    stale_marker: str = "StreamingAssets"
    version_assets: tuple[str, ...] = ("ZenlessZoneZeroBeta_Data/resources.assets", "ZenlessZoneZero_Data/resources.assets")
    version_marker: str = "app_version"
    version_field: str = "DispatchVersion"
    archive_name: str = "zzz-{old}-{new}.zip"
    manifest_limit: int = 128 << 20
    asset_limit: int = 256 << 20
    path_limit: int = 65_535
    block: int = 1 << 20
    scan_block: int = 32_768
    scan_tail: int = 8_192


DEFAULT = Layout()
