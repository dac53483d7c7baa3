"""Manifests, file trees and archives as DataFrames."""
