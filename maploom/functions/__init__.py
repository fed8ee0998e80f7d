"""Part of the certificate-map engine."""
