"""Evidence-backed change tracking over versioned documents, as DataFrame jobs."""
