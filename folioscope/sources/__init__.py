"""Where documents come from: files, frames, crawl tables, earlier audits, image bytes."""
