"""Files by URI: local paths, file, s3, gs and http."""

from __future__ import annotations

import posixpath
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from pyarrow import fs

from ocellus.conf import get_option


def normalize(uri: str | Path) -> str:
    """``file://`` and an absolute path for bare paths; s3a and s3n become s3; others stay."""
    text = str(uri)
    scheme = urlparse(text).scheme
    if scheme in ("s3a", "s3n"):
        return "s3" + text[3:]
    if scheme == "":
        return "file://" + str(Path(text).absolute()) + ("/" if text.endswith("/") and text != "/" else "")
    if scheme == "file" and not text.startswith("file://"):
        return "file://" + text[len("file:") :]
    return text


def same_uri(a: str, b: str) -> bool:
    """Whether two URIs name the same place; a bare path is a file's."""
    return normalize(a) == normalize(b)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(normalize(uri))


def open_input(uri: str):
    """A stream for reading; http URIs are sent with the agent of the options."""
    if urlparse(uri).scheme in ("http", "https"):
        return urlopen(Request(uri, headers={"User-Agent": str(get_option("http.agent"))}))
    place, path = _place(uri)
    return place.open_input_stream(path)


def open_output(uri: str):
    """A stream for writing; the folder is made if need be."""
    place, path = _place(uri)
    place.create_dir(posixpath.dirname(path), recursive=True)
    return place.open_output_stream(path)


def read_bytes(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    with open_output(uri) as f:
        f.write(data)


def exists(uri: str) -> bool:
    place, path = _place(uri)
    return place.get_file_info(path).type != fs.FileType.NotFound


def copy(source: str, target: str) -> str:
    """Copies a file; a target that ends in ``/`` is a folder.  The normalised URI of the copy."""
    target = normalize(target)
    if target.endswith("/"):
        target += posixpath.basename(urlparse(normalize(source)).path)
    if urlparse(source).scheme in ("http", "https"):
        write_bytes(target, read_bytes(source))
        return target
    (a, from_path), (b, to_path) = _place(source), _place(target)
    b.create_dir(posixpath.dirname(to_path), recursive=True)
    fs.copy_files(from_path, to_path, source_filesystem=a, destination_filesystem=b)
    return target


def make_temporary_url(bucket: str, key: str, seconds: int = 3600) -> str:
    """A signed URL of an object in S3; needs boto3."""
    try:
        import boto3
    except ImportError as e:
        raise ImportError("signed URLs need boto3") from e
    return boto3.client("s3").generate_presigned_url("get_object", Params={"Bucket": bucket, "Key": key}, ExpiresIn=seconds)
