"""Image files through a stand-in OCR: several pages, faults, and how they are dealt to tasks."""

from paperproof.operators.ocr_lines import extract_baseline
from paperproof.sources import images as SI


def ocr(page):
    """Words are 'top,left,text' lines; a page that begins with ! can't be read."""
    if page.startswith(b"!"):
        raise ValueError("no image")
    rows = [x.split(",", 2) for x in page.decode().split("\n") if x]
    return {"top": [r[0] for r in rows], "left": [r[1] for r in rows], "text": [r[2] for r in rows], "conf": ["90"] * len(rows)}


def cut(content):
    for page in content.split(b"\f"):
        if page == b"BROKEN":
            raise OSError("cut off")
        yield page


def test_pages_faults_and_lines(spark, tmp_path):
    files = {"one": b"0,0,Tea\n0,9,7\x2c00\n40,0,Gesamt 7\x2c00\n", "two": b"0,0,first\f0,0,second\n90,0,third", "bad": b"!x", "half": b"0,0,kept\fBROKEN\f0,0,never", "empty": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = SI.read_image_lines(spark, str(tmp_path), ocr=ocr, cut=cut)
    rows = sorted((r.document_id.rsplit("/", 1)[1], -1 if r.line_idx is None else r.line_idx, r.text, r.page, r.error) for r in got.collect())
    assert rows == [("bad", -1, None, 0, "ValueError: no image"), ("half", -1, None, 1, "OSError: cut off"), ("half", 0, "kept", 0, None), ("one", 0, "Tea 7,00", 0, None), ("one", 1, "Gesamt 7,00", 0, None), ("two", 0, "first", 0, None), ("two", 1, "second", 1, None), ("two", 2, "third", 1, None)]
    receipts = {r.document_id.rsplit("/", 1)[1]: r for r in extract_baseline(got).collect()}
    assert receipts["one"].total.value == 7 and receipts["one"].line_items[0].description.value == "Tea" and receipts["bad"].total.status == "not_present" and receipts["bad"].line_items == []


def test_files_are_dealt_by_their_bytes(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i}").write_bytes(b"0,0,%d" % i)
    images = SI.read_images(spark, str(tmp_path), bytes_per_task=10)
    assert images.rdd.getNumPartitions() == 11 and images.count() == 20
    assert SI.read_words(images, ocr).count() == 20
    (tmp_path / "none").mkdir()
    assert SI.read_image_lines(spark, str(tmp_path / "none"), ocr=ocr).count() == 0
